"""The pipeline's stages on tables with null and repeated ids: every row has a verdict of its own."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetloom.llm import block_max, classifier, decontaminate, mixing, near_dup, periodic_runs, pii, quality_rules, secrets, sharding, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(9, " ".join(f"item{k}" for k in range(30)))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def stage(spark, folder, make, rows):
    docs = spark.createDataFrame([(d, t, "en", s) for d, t, s in rows], DOCS)
    got = make(spark, docs, folder)
    assert got.columns == docs.columns
    return Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())


def test_quality_judges_rows_of_one_id_one_by_one(spark, folder):
    clean = [(None, text(1), "a"), (None, text(2), "a"), (5, text(3), "a"), (6, text(4), "a")]
    assert stage(spark, folder, corpus_pipeline.quality, [*clean, (None, "short", "a"), (5, "short", "a")]) == Counter(clean)


def test_near_duplicates_drops_copies_of_null_and_repeated_ids(spark, folder):
    rows = [(None, text(1), "a")] * 3 + [(5, text(2), "a")] * 2 + [(5, text(3), "a"), (None, text(4), "a"), (7, text(5), "a")]
    assert stage(spark, folder, corpus_pipeline.near_duplicates, rows) == Counter(set(rows))


def test_decontamination_reads_rows_without_id(spark, folder):
    item = " ".join(f"item{k}" for k in range(30))
    clean = [(None, text(1), "a"), (5, text(2), "a"), (5, text(2), "a")]
    assert stage(spark, folder, corpus_pipeline.benchmark, [*clean, (None, f"{text(3)} {item}", "a"), (5, item, "a")]) == Counter(clean)


def test_mixing_keeps_to_targets_with_one_id(spark, folder):
    rows = [(None, text(f"{s}{k}", 50), s) for s in "abc" for k in range(40)]
    got = stage(spark, folder, corpus_pipeline.mix, rows)
    words = Counter()
    for (_, t, s), n in got.items():
        words[s] += n * len(t.split())
    assert set(got) <= set(rows)
    for s, target in {"a": 4000, "b": 5000 * 2 / 3, "c": 5000 / 3}.items():
        assert abs(words[s] - target) <= 100, words


def plain_pipeline(docs, labels, items):
    """The rows that the first three stages leave, by brute force."""
    words = lambda t: (t or "").encode().split()
    kept = []
    good_ids = {d for d, q in labels if q == 1}
    steps = {}
    for k, (d, t, lang, _) in enumerate(docs):
        n, chars, symbols, dup, repeat, lines, capitals, bangs = quality_rules.measure(t or "")
        if n >= 50 and 100 * repeat <= 50 * n:
            values = {"symbols": symbols / n, "dup_lines": dup / lines, "repeats": repeat / n, "capitals": capitals / chars, "bangs": bangs / n}
            steps[k] = max(max(0, math.ceil(quality_rules.DOUBLING * math.log2(v / quality_rules.RULES[r][1]))) if v > quality_rules.RULES[r][1] else 0 for r, v in values.items())
    strata = {docs[k][2] for k in steps if docs[k][0] in good_ids}
    cut = {
        s: quality_rules.certified(
            Counter(steps[k] for k in steps if docs[k][2] == s and docs[k][0] in good_ids),
            0.05,
            0.05 / len(strata),
        ) for s in strata
    }
    kept = [docs[k] for k in steps if cut.get(docs[k][2]) is None or steps[k] <= cut[docs[k][2]]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words((t or "").lower()) for _, t, _, _ in kept)]
    top = list(range(len(kept)))
    while True:
        new = [min(top[j] for j in range(len(kept)) if j == i or 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])) for i in range(len(kept))]
        if new == top:
            break
        top = new
    kept = [kept[i] for i in range(len(kept)) if top[i] == i]

    def score(item, text):
        row, best = [0] * (len(text) + 1), 0
        for a in item:
            line = [0]
            for k, b in enumerate(text, 1):
                line.append(max(0, row[k - 1] + (2 if a == b else -1), row[k] - 1, line[k - 1] - 1))
            row, best = line, max(best, max(line))
        return best / (2 * len(item))

    return [x for x in kept if not any(score(words(i.lower()), words((x[1] or "").lower())) >= 0.5 for i in items)]


def test_run_matches_the_plain_pipeline(spark, tmp_path):
    r = random.Random(21)
    items = [" ".join(f"item{k}x{j}" for j in range(40)) for k in range(3)]
    docs = [(k, text(k, 60 + k % 40), "en" if k % 3 else "de", "abc"[k % 3]) for k in range(280)]
    docs += [(300 + k, text(k, 60 + k % 40), "en", "a") for k in range(30)]  # copies
    docs += [(400 + k, text(k, 60 + k % 40).replace("w1", "W1", 1) + " end", "en", "b") for k in range(30)]  # near copies
    docs += [(500 + k, f"{text(900 + k, 50)} {items[k % 3]} {text(950 + k, 30)}", "en", "c") for k in range(6)]  # leaks
    docs += [(600 + k, " ".join(f"#{w}|*" for w in text(700 + k, 60).split()), "en", "a") for k in range(8)]  # junk
    docs += [(700, None, "en", "a"), (701, "", None, None), (702, "too short", "en", None)]
    labels = [(k, 1) for k in range(280)] + [(600, 0), (None, 1), (5, None)]
    r.shuffle(docs)
    spark.createDataFrame([(*d, 9) for d in docs], DOCS + ", n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_pipeline(sorted(docs), labels, items)
    assert {d for d, *_ in want} == set(range(280))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies, by = Counter(x["doc_id"] for x in got), {}
    size = {d: len(t.split()) for d, t, _, _ in want}
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    # sources weigh 5, 2, 1 and share one and a half times all words, at most twice their own
    own = Counter()
    for d, _, _, s in want:
        own[s] += size[d]
    total = 1.5 * sum(own.values())
    a = min(2 * own["a"], total * 5 / 8)
    target = {"a": a, "b": (total - a) * 2 / 3, "c": (total - a) / 3}
    source = {d: s for d, _, _, s in want}
    for s, t in target.items():
        assert abs(sum(n * size[d] for d, n in copies.items() if source[d] == s) - t) <= 100, s
    for x in got:
        by.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_stages_on_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS + ", n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, text(1), "en", "a", 5), (None, text(2), None, None, None)], DOCS + ", n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, some, str(tmp_path)).count() == 2


#: Names that stages and operators use for columns of their own.
OWN = ["row", "doc", "row_of_stage", "gone", "good", "row_taken", "n_taken", "copy_taken", "id", "n", "listed", "node", "fp", "component", "stratum", "step", "block", "size", "taken", "target", "h", "score", "begin", "col"]


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.createDataFrame([(k, text(k), "en", "a", *[f"{n}{k}" for n in OWN]) for k in range(12)], DOCS + "".join(f", {n} string" for n in OWN))
    for name, make in corpus_pipeline.STAGES[:-1]:
        got = make(spark, docs, folder)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in OWN), name
    assert corpus_pipeline.shards(spark, docs, folder).count() == 12


def test_operators_ignore_columns_of_any_name(spark, folder):
    plain = spark.createDataFrame([(k, text(k // 2), "en", "a") for k in range(12)], DOCS)
    more = plain.select("*", *[F.lit(1).alias(n) for n in OWN])
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for f in (
        pii.find_pii,
        lambda d: quality_rules.judge(d, labels),
        mixing.mix,
        near_dup.near_duplicates,
        secrets.find_secrets,
        substring_dedup.remove_repeats,
        lambda d: classifier.classify(d, labels),
        lambda d: decontaminate.contaminated(d, bench),
        sharding.shard,
        simhash.simhash_duplicates,
        lambda d: periodic_runs.periodic_runs(periodic_runs.with_periods(d)),
        lambda d: block_max.rank_documents(d, bench),
    ):
        a, b = f(plain), f(more)
        assert a.columns == b.columns
        assert sorted(map(str, a.drop("slot", "text_crc32").collect())) == sorted(map(str, b.drop("slot", "text_crc32").collect()))
