"""Workbooks that arrive as files: each micro-batch is parsed on its own, as workbooks are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs.schedules import parse_schedules
from ..sources.intake import read_workbooks, split_records, triage_files


def parse_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse new `.xlsx` files of `folder`; products, names and errors are appended under `out`.

    One pass over what is there (`availableNow`), then the query ends; the checkpoint knows what
    is done, so no file is parsed twice.
    """

    def batch(files: DataFrame, batch_id: int) -> None:
        triaged = triage_files(files)
        work = f"{out}/records/{batch_id}"
        read_workbooks(triaged.where("status = 'ok'")).write.mode("overwrite").parquet(work)
        parts = split_records(spark.read.parquet(work))
        products, names = parse_schedules(parts["cells"], parts["sheets"], parts["merges"])
        products.write.mode("overwrite").parquet(f"{out}/products/batch={batch_id}")
        names.write.mode("overwrite").parquet(f"{out}/names/batch={batch_id}")
        errors = parts["errors"].unionByName(triaged.where("status = 'error'").select("workbook_id", "error", "detail"))
        errors.write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


