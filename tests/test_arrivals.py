from books import xlsx

from sheetloom.streaming.arrivals import parse_arrivals


def _book(code):
    head = ["Product Code", "Item", "Specification", "Qty", "Manufacturer", "RRP"]
    first = [code, "Lamp", "COLOUR: White\nWIDTH: 20 CM", 2, "NAME: Acme", 99.5]
    return xlsx({"Items": [["Lighting Fixtures Schedule"], [], head, first, [code, "Lamp again", None, 1, None, None]]})


def test_each_file_is_parsed_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "one.xlsx").write_bytes(_book("A-1"))
    (inbox / "two.txt").write_bytes(b"x" * 200)

    def run():
        parse_arrivals(spark, str(inbox), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return [spark.read.parquet(f"{tmp_path}/out/{t}") for t in ("products", "names", "errors")]

    for _ in range(2):  # nothing new the second time
        products, names, errors = run()
        got = [(r["doc_code"], r["product_name"], r["brand"], r["colour"], r["width"], r["qty"], r["rrp"], r["seq"]) for r in products.collect()]
        assert got == [("A-1", "Lamp", "Acme", "White", 200, 2, 99.5, 1)]
        assert [r["schedule_name"] for r in names.collect()] == ["Lighting Fixtures Schedule"]
        assert [r["error"] for r in errors.collect()] == ["Invalid file type"]
