"""Operators held against plain brute-force versions, and their promises against simulations."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheetloom.llm import classifier, decontaminate, html_text, mixing, near_dup, quality_rules, secrets, sharding, substring_dedup

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


# --- quality rules -------------------------------------------------------------------------------------------------


def test_rule_metrics_match_brute_force():
    r = random.Random(1)
    for k in range(400):
        text = "".join(
            r.choice(["a", "b", "é", "A", "#", "|", "!", " ", " ", "\n", "\t", " ", "aa ", "x\n"]) for _ in range(r.randint(0, 90 if k else 20000))
        )
        words = split(text)
        lines = [x for x in text.split("\n") if split(x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        want = (
            len(words),
            sum(map(len, words)),
            sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)),
            len(repeated),
            len(lines),
            sum(c.isascii() and c.isupper() for c in text),
            text.count("!"),
        )
        if not words:
            want = (0,) * 8
        assert quality_rules.measure(text) == want, text


def test_false_certificates_are_as_rare_as_promised():
    """Families whose next step lies exactly at the limit: the share of runs with any certificate for it is delta at most."""
    rng, alpha, delta, families, n, runs = np.random.default_rng(5), 0.05, 0.05, 20, 2000, 150
    wrong = 0
    for _ in range(runs):
        for _ in range(families):
            bad = rng.binomial(n, alpha)  # documents that step 0 rejects, and no step above
            found = quality_rules.certified({1: int(bad), 0: int(n - bad)}, alpha, delta / families)
            if found == 0:
                wrong += 1
                break
    assert wrong / runs <= delta + 3 * math.sqrt(delta * (1 - delta) / runs)


def test_certificates_need_enough_labels():
    for strata, least in ((1, 59), (4, 86)):
        for n in (least - 1, least):
            assert (quality_rules.certified({0: n}, 0.05, 0.05 / strata) == 0) == (n == least)


def test_rules_reject_what_no_good_document_looks_like(spark):
    r = random.Random(4)
    good = [(k, " ".join(f"w{r.randrange(9999)}" for _ in range(80)), "en" if k % 2 else None) for k in range(240)]
    junk = [
        (1000, " ".join(f"w{k}#|*" for k in range(80)), "en"),
        (1001, " ".join(f"w{k}#|*" for k in range(80)), "xx"),
        (1002, None, "en"),
        (1003, "", None),
    ]
    docs = spark.createDataFrame([(*g, 1, 2, 3) for g in good + junk], "doc_id long, text string, lang string, step int, stratum int, n int")
    labels = spark.createDataFrame([(k, 1) for k in range(240)] + [(0, None), (None, 1), (0, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality_rules.judge(docs, labels).collect()}
    assert all(got[k]["kept"] for k in range(240))
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert got[1001]["kept"]  # a stratum without labels has base rules only
    assert got[1002]["base_failed"] and got[1003]["n_words"] == 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def targets(sizes):
    """Targets by source, filled up step by step."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_targets_of_large_and_tiny_sources(spark):
    r = random.Random(2)
    sizes = {f"s{k:03}": r.randint(1, 50) for k in range(60)} | {"s900": 40_000, "s901": 30_000, None: 2}
    rows, n = [], 0
    for s, size in sizes.items():
        while size:
            words = min(size, r.choice([1, 3, 20, 400, 9000]))
            rows.append((n if n % 7 else None, " ".join(["w"] * words), s))
            size, n = size - words, n + 1
    rows += [(5, "", "s900"), (6, None, "empty"), (7, " \n", None)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, size int, rank int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    want = targets(sizes | {"empty": 0})
    taken, by = Counter(), defaultdict(set)
    for x in got:
        taken[(x["source_size"], x["target"])] += x["taken"]
    for s, t in want.items():
        by[(dict(sizes, empty=0)[s], round(t, 6))].add(s)
    for (size, target), words in taken.items():
        alike = len(by[(size, round(target, 6))])
        assert alike, (size, target)
        assert abs(words - alike * target) <= alike * max(0.5, size / 1024) + 1e-6, (size, target, words)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


# --- near-duplicates -------------------------------------------------------------------------------------------------


def test_links_of_large_sets_are_found(spark):
    """Pairs of 65 to 2000 shingles whose similarity is just above the limit, and some just below."""
    r, rows, want = random.Random(8), [], {}
    for k in range(240):
        n = r.choice([5, 9, 30, 48, 49, 63, 64, 65, 66, 80, 86, 120, 300, 2000])
        a = [f"p{k}x{r.randrange(10**6)}" for _ in range(n + 4)]
        b = a[:]
        for _ in range(400):
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
            c = b[:]
            c[r.randrange(len(c))] = f"new{r.randrange(10**9)}"
            z = {tuple(c[i : i + 5]) for i in range(len(c) - 4)}
            if 4 * len(x & z) < 3 * len(x | z):
                break
            b = c
        b = b if k % 5 else c  # every fifth pair is one edit too far
        y = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b).upper().replace("P", "p"))]
        want[2 * k + 1] = 2 * k if 4 * len(x & y) >= 3 * len(x | y) else 2 * k + 1
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want


def test_chance_of_a_missed_link():
    assert sum(math.comb(64, k) * 0.75**k * 0.25 ** (64 - k) for k in range(near_dup.LEAST)) < 1e-7


@pytest.mark.parametrize("block", [1024, 8])
def test_large_group_of_edited_copies_beside_common_passages(spark, monkeypatch, block):
    """A group whose copies differ from each other, and documents that share a long passage but are no copies."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**7)}"
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = []
    for _ in range(120):
        t = base[:]
        for i in r.sample(range(150), 3):
            t[i] = word()
        texts.append(t)
    texts += [passage + [word() for _ in range(50)] for _ in range(80)] + [[], ["one"], ["one"], ["one", "two"]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    top = list(range(len(texts)))
    while True:
        new = [
            min(
                [top[j] for j in range(len(texts)) if j == i or sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])],
            ) for i in range(len(texts))
        ]
        if new == top:
            break
        top = new
    docs = spark.createDataFrame([(k, " ".join(t), 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, node int, value int, comp int")
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == top


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_secret_base_matches_the_patterns():
    r = random.Random(6)
    patterns = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    fits = [lambda m: len(m[1]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    pieces = [
        "password",
        "Token",
        "api_key",
        "APIKEY",
        "secret",
        ":",
        "=",
        " ",
        '"',
        "'",
        "abc123",
        "AKIA",
        "ABCDEFGHIJ",
        "0123456789ab",
        "x-y.z",
        "é",
        "ſecret",
        "\n",
    ]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t, re.ASCII) if fits[k](m))
        assert [x for x in secrets.find(t) if x[1] < 3] == want, t


def test_random_letters_are_no_words():
    r = random.Random(14)
    for s in ("ordinaryWordsJoinedInCamelCase", "path/to/some_module/another-file_name", "SCREAMING_SNAKE_CASE_NAMES", "internationalization2024"):
        assert secrets.allowed(s), s
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    made = ["".join(r.choice(letters) for _ in range(32)) for _ in range(300)]
    assert sum(map(secrets.allowed, made)) <= 6
    assert [x[1] for x in secrets.find(f"key {made[0]} end")] == [3]


def test_window_entropy_matches_brute_force():
    r = random.Random(7)
    for _ in range(300):
        s = "".join(r.choice("abcdef0123456789XYZ") for _ in range(r.randint(1, 70)))
        w = min(20, len(s))
        best = max(-sum(n / w * math.log2(n / w) for n in Counter(s[k : k + w]).values()) for k in range(len(s) - w + 1))
        assert abs(secrets.window_entropy(s) - best) < 1e-9


def test_long_texts_take_time_in_proportion():
    from sheetloom.llm import pii

    for find in (secrets.find, pii.find, quality_rules.measure, classifier.bins):
        for piece in ("1", "a@", "+1", "://", "aB3", "token=", "0.", "word "):
            t = time.time()
            find(piece * (300_000 // len(piece)))
            assert time.time() - t < 8, (find, piece)


# --- classifier -------------------------------------------------------------------------------------------------------


def test_risk_by_moments_is_the_risk_by_sums():
    rng = np.random.default_rng(9)
    groups = list(zip(classifier.OFFSETS.values(), (len(e) + 1 for e in classifier.EDGES.values()), strict=True))
    x = np.zeros((300, classifier.WIDTH))
    for begin, n in groups:
        x[np.arange(300), begin + rng.integers(0, n, 300)] = 1
    positive = rng.random(300) < 0.4
    u, p = x.T @ x, x[positive].T @ x[positive]
    w = classifier.minimise(u, p, 0.3)
    risk = lambda w: 0.3 * ((1 - x[positive] @ w) ** 2).mean() / 4 + max(0.0, ((1 + x @ w) ** 2).mean() / 4 - 0.3 * ((1 + x[positive] @ w) ** 2).mean() / 4) + classifier.RIDGE * w @ w / 4
    at = risk(w)
    assert all(at <= risk(w + 0.01 * rng.standard_normal(len(w))) + 1e-9 for _ in range(200))


@pytest.mark.parametrize("kept", [1.0, 0.1])
def test_prior_does_not_follow_the_labelling(spark, kept):
    """Half of all text is good; of the bad documents nearly all or few are labelled."""
    r = random.Random(10)
    good = lambda: " ".join(r.choice(["the", "river", "flows", "Slowly.", "down", "to"]) + str(r.randrange(30)) for _ in range(90))
    bad = lambda: " ".join("#|* $$ !!" for _ in range(30))
    docs = [(k, good() if k % 2 else bad()) for k in range(2000)]
    labels = [(k, k % 2) for k in range(2000) if k % 2 or r.random() < kept]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = classifier.features(d).join(lab.where("quality = 1"), "doc_id", "left").selectExpr("bins", "quality is not null as positive")
    u, p = classifier.moments(rows)
    assert 0.45 <= classifier.estimated_prior(rows, u, p) <= 0.6
    got = classifier.classify(d, lab).collect()
    assert all((x["predicted"] == 1) == (x["doc_id"] % 2 == 1) for x in got)


# --- HTML ------------------------------------------------------------------------------------------------------------

P = "<p>" + "word text here " * 12 + "</p>"
WORDS = ("word text here " * 12).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout with-sidebar"><h1>T</h1>{P}{P}</div>', f"T\n{WORDS}\n{WORDS}"),
        (f'<div class="legal-analysis"><h1>T</h1>{P}</div>', f"T\n{WORDS}"),
        (f'<article class="post has-sidebar"><header class="article-header"><h1>T</h1></header>{P}</article>', f"T\n{WORDS}"),
        ("<article><p>x<y</p><p>b</p></article>", "x<y\nb"),
        ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
        (P + '<div class="ad">1</div>' * 3 + "<p>short end</p><footer>f</footer>", f"{WORDS}\nshort end"),
        (f'{P}<p>see <a href="x">a link that is longer than all other text</a> ok</p>{P}<ul><li><a>rel</a><li><a>more</a></ul>', f"{WORDS}\nsee a link that is longer than all other text ok\n{WORDS}"),
        (f'<div id="comments"><p>x</p>{P}{P}{P}</div><div>{P}</div>', WORDS),
        (f'<nav>Home</nav><article>{P}<aside>s</aside><form>f <select><option>o</select></form></article><div class="cookie-banner">{P}</div>', WORDS),
        ("<article>a&nbsp;&#32; b &lt;p&gt; &amp;amp;<br>c</article>", "a b <p> &amp; c"),
        (f"<title>t</title><script>if (a<b) '</p>'</script>{P}<!-- gone --><style>p{{}}</style>", WORDS),
        (f"{P}<p>last <b", f"{WORDS}\nlast"),
        ("<nav>only</nav>", ""),
        ("plain words", "plain words"),
        (f"<div>Home</div><div>About</div><div>Jobs</div><div>Contact</div>{P}{P}<p>The end.</p>", f"{WORDS}\n{WORDS}\nThe end."),
        (f"{P}{P}<div>Copyright 2024 Example Inc. All rights reserved.</div>", f"{WORDS}\n{WORDS}"),
        (f"{P}{P}<div>Contact us at the office</div>", f"{WORDS}\n{WORDS}"),
        (f"<div>Home</div><div><h1>A title</h1></div><article>{P}<p>x</p></article><div>Our other pages</div><p>We use cookies.</p>", f"A title\n{WORDS}\nx"),
        (f"<main><p>Teaser.</p></main>{P}{P}{P}", f"Teaser.\n{WORDS}\n{WORDS}\n{WORDS}"),
        (f'<article><h1>T</h1><p>u</p></article><div class="ad">{P}</div>', "T\nu"),
        ("", ""),
    ],
)
def test_main_text_of_pages(page, text):
    assert html_text.extract(page) == text


def plain_stretches(weights, window=3, surge=80, dive=20, line=10):
    """Text by the sums, worked out for each line on its own."""
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    least = min(surge, max(sums, default=0) / 4)
    kept, k = [], 0
    while k < len(sums):
        if not sums[k] or sums[k] < least:
            k += 1
            continue
        first = min((j for j in range(k, min(k + window, len(weights))) if weights[j] >= line), default=None)
        if first is None:
            k += 1
            continue
        end = k
        while end < len(sums) - 1 and sums[end] >= min(dive, least):
            end += 1
        last = [j for j in range(first, min(end + window - 1, len(weights))) if weights[j] >= line]
        kept.append((first, max(last, default=first)))
        k = end + 1
    return kept


def test_windows_match_a_plain_version():
    r = random.Random(12)
    for _ in range(3000):
        weights = [r.choice([0, 0, 3, 9, 10, 15, 40, 80, 300]) for _ in range(r.randrange(0, 25))]
        assert html_text.stretches(weights) == plain_stretches(weights), weights


def test_the_windows_decide(monkeypatch):
    """With windows of one line, text around a title and short lines between long ones are lost, on marked and unmarked pages."""
    pages = (f"<div><h1>A title</h1></div><article>{P}</article>", f"{P}<div>1</div><div>2</div>{P}")
    with_windows = [html_text.extract(p) for p in pages]
    assert with_windows == [f"A title\n{WORDS}", f"{WORDS}\n1\n2\n{WORDS}"]
    monkeypatch.setattr(html_text, "WINDOW", 1)
    assert all(html_text.extract(p) != t for p, t in zip(pages, with_windows, strict=True))


def test_broken_markup_takes_linear_time():
    for piece in ("<a ", '<a "', "<svg>", "<!--", "<![CDATA[", "<script>", "<noscript>", "</", "<", "<a x='\"<b ", "<p>", "<div class=ad>"):
        t = time.time()
        html_text.extract(piece * (200_000 // len(piece)))
        assert time.time() - t < 3, piece


def test_pages_of_every_kind(spark):
    rows = [
        (1, "u", None, 1),
        (2, None, "", 1),
        (3, "u", f"<article>{P}", 1),
        (3, "u", f"<article>{P}", 1),
        (None, "u", "<p>" + "long " * 200_000, 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.main_text(pages).collect()
    assert Counter((x["page_id"], x["n_chars"]) for x in got) == Counter({(1, 0): 1, (2, 0): 1, (3, len(WORDS)): 2, (None, 999_999): 1})
    assert html_text.main_text(pages.where("1 = 0")).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def best_alignment(item, text):
    """Smith-Waterman over all cells."""
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        new = [0]
        for k, b in enumerate(text, 1):
            new.append(max(0, row[k - 1] + (2 if a == b else -1), row[k] - 1, new[k - 1] - 1))
        row, best = new, max(best, max(new))
    return best


def test_decontamination_matches_full_alignment(spark):
    r = random.Random(11)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 25, 60]))] for _ in range(25)]
    docs = []
    for k in range(120):
        t = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if k % 2:
            part = r.choice(items)[:]
            for _ in range(r.randint(0, len(part))):
                i = r.randrange(len(part))
                part[i : i + 1] = r.choice([[], [r.choice(vocabulary)], [part[i], r.choice(vocabulary)]])
                if not part:
                    break
            t[len(t) // 2 : len(t) // 2] = part
        docs.append(t)
    d = spark.createDataFrame(
        [(k, " ".join(t).upper(), 1, 2, 3) for k, t in enumerate(docs)] + [
            (0, " ".join(docs[0]), 1, 2, 3),
            (None, " ".join(items[3]), 1, 2, 3),
            (999, None, 1, 2, 3),
        ],
        "doc_id long, text string, words int, grams int, item_id int",
    )
    b = spark.createDataFrame(
        [(k, " ".join(t), 1) for k, t in enumerate(items)] + [(0, " ".join(items[0]), 1), (77, None, 1), (78, "", 1)],
        "item_id long, text string, doc_id int",
    )
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(d, b).collect()}
    for i, t in enumerate(docs):
        grams = {tuple(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
        for j, item in enumerate(items):
            n = min(3, len(item))
            score = best_alignment(item, t) / (2 * len(item))
            seeded = any(tuple(item[k : k + n]) in grams for k in range(len(item) - n + 1))
            if seeded and score >= 0.5:
                assert got.pop((i, j)) == pytest.approx(score), (i, j)
    assert not got


def test_seeds_that_are_rare_find_edited_copies(spark):
    """Items half of whose n-grams stand in every document: rare seeds find nearly all edited copies, all seeds find all of them."""
    r = random.Random(21)
    word = lambda: f"u{r.randrange(10**6)}"
    common = [word() for _ in range(15)]
    items = [common + [word() for _ in range(25)] for _ in range(30)]
    docs, copies = [], {}
    for k in range(300):
        t = [word() for _ in range(40)] + common + [word() for _ in range(40)]
        if k % 3 == 0:
            j = r.randrange(len(items))
            part = items[j][:]
            for i in r.sample(range(len(part)), 6):
                part[i] = word()
            copies[k, j] = best_alignment(items[j], t[:20] + part + t[20:]) / (2 * len(items[j]))
            t[20:20] = part
        docs.append(t)
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    wanted = {p for p, score in copies.items() if score >= 0.5}
    found = {rare: {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, b, rare=rare, item_words=400).collect()} for rare in (60, None)}
    assert len(wanted) > 60 and wanted <= found[None]
    assert len(wanted & found[60]) >= 0.9 * len(wanted)
    assert found[60] <= found[None]
    index = decontaminate.Index([1, 2], [np.arange(8), np.arange(8) + 4], [np.arange(6), np.arange(6) + 4])
    index.seeded(np.array([9, 1, 1, 1, 9, 9, 1, 1, 1, 1]), 5)
    assert [int(g) for g in range(10) if index.at[g] < index.at[g + 1]] == [1, 2, 3, 6, 7, 8, 9]


# --- sharding ---------------------------------------------------------------------------------------------------------


def check_shards(rows, got):
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter((d, len((t or "").encode()) + 1, __import__("zlib").crc32((t or "").encode())) for d, t in rows)
    by, load = defaultdict(list), Counter()
    for x in got:
        by[x["shard"]].append(x["slot"])
        load[x["shard"]] += x["size"]
        assert x["law"] == "bytes" and x["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return load


def test_shards_are_even_and_keep_groups(spark):
    r = random.Random(12)
    rows = [(k if k % 9 else None, "x" * r.randint(0, 400) + str(k)) for k in range(6000)]
    groups = {f"group {g} " * n: copies for g, (n, copies) in enumerate([(3, 40), (10, 200), (30, 60), (1, 900), (2, 2)])}
    for t, copies in groups.items():
        rows += [(len(rows) + k, t) for k in range(copies)]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, h int, size int, shard int")
    got = sharding.shard(docs).collect()
    load = check_shards(rows, got)
    share = sum(load.values()) / 16
    assert all(abs(b - share) <= 0.02 * share + 450 for b in load.values())
    placed = defaultdict(set)
    for x in got:
        placed[(x["text_crc32"], x["size"])].add(x["shard"])
    assert all(len(s) == 1 for s in placed.values())


def test_hot_text_spreads_over_shards(spark):
    rows = [(k, "hot text") for k in range(3000)] + [(k, f"other {k}") for k in range(3000)] + [
        (1, None),
        (2, ""),
        (None, "hot text"),
        (5, "y" * 150_000),
    ]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = check_shards(rows, got)
    most = max(load.values())
    assert most == 150_001  # one document is larger than all others together; the rest is even
    rest = [b for b in load.values() if b != most]
    assert max(rest) - min(rest) <= 0.03 * max(rest) + 20


def test_substring_dedup_of_very_long_and_hot_texts(spark):
    r = random.Random(13)
    word = lambda: f"w{r.randrange(10**6)}"
    hot = [word() for _ in range(80)]
    texts = [
        [word() for _ in range(60)] + hot[:40] + [word() for _ in range(30)] for _ in range(60)
    ] + [hot] * 50 + [[word() for _ in range(60_000)] + hot] + [["same"] * 200, ["same"] * 34, ["same"] * 35]
    count = Counter(tuple(t[k : k + 35]) for t in texts for k in range(len(t) - 34))
    want = Counter()
    for d, t in enumerate(texts):
        gone = {k + j for k in range(len(t) - 34) if count[tuple(t[k : k + 35])] > 1 for j in range(35)}
        want[(d, len(t), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(t) if k not in gone).encode()).hexdigest())] += 1
    docs = spark.createDataFrame([(d, "  ".join(t) + "\n", 1, 2) for d, t in enumerate(texts)], "doc_id long, text string, ref int, spots int")
    assert Counter(map(tuple, substring_dedup.remove_repeats(docs).collect())) == want
