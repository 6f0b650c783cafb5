"""Each operator against a brute-force version on a small table of awkward cases, on empty tables and with further
columns whose names operators use themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, documents, words
from pyspark.sql import functions as F

from tessera.llm import decontamination, html_text, line_dedup, lm, mixing, near_dedup, pii, token_counts, topk, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(df, key=("doc_id",)):
    return sorted((tuple(r) for r in df.collect()), key=str)


def crowded(docs, *names):
    """The table with further columns."""
    return docs.withColumns({n: F.lit("?") for n in names})


# --- personal data -------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    out = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


PII = [
    "mail a.b@c-d.example.com, x@y.z_w@q.r and é@e.fr 😀 me@here.org.",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3",
    "cards 4041894974608795 4041 8949 7460 8795 4041-8949-7460-8796 12345678901234567890123",
    "phones +1 (386) 555-3733 +44 20 7946 0958 +123 +1234567890123456 ++1 212 555 0153",
    "😀😀 +1 212 555 0153 at a@b.cd",
    None,
    "",
    "a" * 20_000 + "@" + "1" * 20_000,
    "a@b" + ".c" * 5_000,
    "1 " * 20_000,
]


def test_pii_base_spans(spark):
    d = spark.createDataFrame(list(enumerate(PII)) + [(0, PII[0]), (None, PII[1])], "doc_id bigint, text string")
    got = pii.report(crowded(d, "base", "terms", "text_key", "spans")).collect()
    assert len(got) == len(PII) + 2
    for r in got:
        want = base_spans((PII[r.doc_id] if r.doc_id is not None else PII[1]) or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want
        assert r.n_email == want.count("email:") and r.n_phone == want.count("phone:")


def test_pii_terms_that_give_a_value_away(spark):
    filler = ["alpha beta gamma", "delta omega sigma", "kappa lambda tau", "rho phi chi", "psi zeta theta", "iota xi nu"]
    rows = [(i, f"{filler[i]} ask Zorbly at z.k@corp.example.com about the {filler[-1 - i]}") for i in range(6)]
    rows += [(10 + i, f"the {f} and the weather") for i, f in enumerate(filler * 5)]
    rows += [(99, "here Zorbly stands alone, with the rest"), (98, "Zorblyx is someone else")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    r = {x.doc_id: x for x in pii.report(d).collect()}
    assert r[99].spans == "term:5:11" and r[98].spans == "" and r[10].spans == ""
    assert "term:" in r[0].spans and "email:" in r[0].spans
    clean = {x.doc_id: x.text for x in pii.sanitise(d).collect()}
    assert "Zorbly" not in clean[99] and "<EMAIL>" in clean[0] and clean[98] == rows[-1][1]


def test_pii_empty(empty):
    assert pii.report(empty).count() == 0


# --- token counts --------------------------------------------------------------------------------------------------


def test_token_histogram(spark, docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    from pathlib import Path

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(token_counts.TOKENIZER).open("rb"))}
    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = [len(enc.encode_ordinary(r[1] or "")) for r in rows]
    h = token_counts.report(crowded(docs, "length", "n_tokens"))
    got = {r.length: r for r in h.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert r.docs_from == sum(x >= k for x in n) and r.tokens_from == sum(x for x in n if x >= k)
        assert r.truncated_tokens == sum(min(x, k) for x in n)
        assert math.isclose(r.share_within, sum(x <= k for x in n) / len(n))
    for r in token_counts.truncated(h, [0, 5, 1000, 10**9]).collect():
        assert r.truncated_tokens == sum(min(x, r.limit) for x in n) and r.n_docs == sum(x > r.limit for x in n)
    for r in token_counts.quantiles(h, [0.5, 1.0]).collect():
        assert r.length == sorted(n)[math.ceil(r.share * len(n)) - 1]


def test_token_histogram_empty(empty):
    assert token_counts.report(empty).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------

ITEM = "A train leaves the old station at 7 and covers 120 km in 3 hours before Alice boards it with 7 heavy bags and a dog"


def test_decontamination_templates(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ITEM)], "item_id bigint, text string")
    swapped = ITEM.replace(" 7 ", " 9 ").replace("120", "455").replace("Alice", "Robert").replace(" 3 ", " 5 ")
    broken = ITEM.replace("at 7", "at 9").replace("with 7", "with 31")  # one value of the item, two of the document
    rows = [(10, "lead in words here. " + ITEM), (11, swapped + " and more text follows"), (12, broken), (13, "nothing of the kind stands here at all"), (14, None), (15, "")]
    rows += [(16, ITEM.upper()), (11, swapped + " and more text follows"), (None, ITEM), (17, " ".join(ITEM.split()[:14])), (18, ITEM.replace("old station", "new station"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(crowded(d, "h", "i", "slots", "items"), bench).collect()}
    assert {(10, 1), (11, 1), (None, 1)} <= got
    assert not got & {(12, 1), (13, 1), (14, 1), (17, 1)}
    kept = decontamination.clean_documents(crowded(d, "h", "__x"), bench)
    ids = [r.doc_id for r in kept.collect()]
    assert 13 in ids and 14 in ids and 10 not in ids and 11 not in ids and None not in ids and kept.columns == ["doc_id", "text", "h", "__x"]


def test_decontamination_items_of_one_template(spark):
    text = "we put {} apples and {} pears into the basket by the door and went home"
    bench = [(1, text.format(5, 5)), (2, text.format(5, 7)), (3, text.format(8, 9))]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    d = spark.createDataFrame([(10, "before it " + bench[1][1]), (11, "before it " + text.format(4, 4))], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(d, b).collect()}
    assert {(10, 2), (10, 3), (11, 1)} <= got and (10, 1) not in got
    assert decontamination.clean_documents(d, b).count() == 0


def test_decontamination_repeating_templates(spark):
    texts = ["1 and 2 and 1 and 3 and 1 and 4 and 1 and 5 and 1 and 6 and 1 and 7", "compute the sum of 3 and 5 and 3 and 8 and 3 and 9 and 3 and 4 and 3 and 6", "row 1 has 2 red and 3 blue row 2 has 4 red and 5 blue row 3 has 6 red and 2 blue row 4 has 1 red and 7 blue"]
    b = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = [(10 + i, f"words before {t} and words after") for i, t in enumerate(texts)]
    rows += [(20, texts[1].replace("and 3", "and 7", 1)), (21, f"{texts[1].replace('and 3', 'and 7', 1)} {texts[1]}")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(d, b).collect()}
    assert {(10, 0), (11, 1), (12, 2), (21, 1)} <= got and (20, 1) not in got
    assert {r.doc_id for r in decontamination.clean_documents(d.where("doc_id < 20"), b).collect()} == set()


def test_decontamination_names_and_units(spark):
    tom = "Tom buys 3 apples at the market. Tom eats 2 of them on the way home. How many apples does Tom have left?"
    hour = "the slow boat needs 1 hour to cross the wide lake"
    b = spark.createDataFrame([(1, tom), (2, hour)], "item_id bigint, text string")
    anna = tom.replace("Tom", "Anna").replace("3", "8")
    rows = [(10, f"text before. {anna}"), (11, f"He said: \"{anna}\""), (12, anna.replace(" Anna", "\nAnna")), (13, tom.upper()), (14, tom.title()), (15, hour.replace("1 hour", "3 hours")), (16, hour.replace("1 hour", "3\nHours"))]
    rows += [(17, "Tom runs to the market and How he eats nobody knows"), (18, tom.replace("How", "And how"))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.report(d, b).collect()}
    assert got == {(i, 1) for i in (10, 11, 12, 13, 14, 18)} | {(15, 2), (16, 2)}


def test_decontamination_brute_force(spark, docs, rows):
    bench = [(i, rows[2 * i][1]) for i in range(6)]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    want = {(r[0], i) for r in rows for i, t in bench if grams(t) and len(grams(t) & grams(r[1])) / len(grams(t)) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in decontamination.report(docs, b).collect()} == want


def test_decontamination_empty(spark, docs, empty):
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert decontamination.report(empty, b).count() == 0
    assert decontamination.clean_documents(docs, b.limit(0)).count() == docs.count()


# --- main text -----------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>Big  news</h1><p>One &amp; two\nthree<p>Four &#233; <b>five</b>s</article><footer>legal words here</footer>", "Big news\nOne & two three\nFour é fives"),
    ("<div id=wrap><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><div id=content><h2>Title here now</h2><p>Alpha beta gamma delta.<div class=ad>Buy this</div><p>Second one<br>three</p><ul><li>item one<li>item two</ul></div><aside>side</aside><div class=comments><p>Reader said something quite long here</p></div><form>Search <button>Go</button></form></div>", "Title here now\nAlpha beta gamma delta.\nSecond one three\nitem one\nitem two"),
    ("<article class=post><header><h1>Head</h1></header><p>Words in the article.</p><script>var a='</p><p>no</p>'</script><section id=comments><p>First comment is long and should go.</p></section></article>", "Head\nWords in the article."),
    ("<div class='page with-sidebar'><div class='two ads'><article><p>In a wrapper with an odd name.</p></article></div><div class=sidebar>links</div></div>", "In a wrapper with an odd name."),
    ("<main><p>The main text stands here.</p></main><div class=comments><article><p>A comment as an article.</p></article></div>", "The main text stands here."),
    ("just plain text", "just plain text"),
    ("", ""),
    (None, ""),
    ("<!-- never closed <p>x</p>", ""),
    ("<p>one here<p>two of the <i>three</i> <", "one here\ntwo of the three <"),
]


def test_main_text(spark):
    d = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0])], "page_id bigint, url string, html string")
    got = html_text.report(crowded(d, "text", "n_chars")).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def weights():
    return html_text.learn(html_text.labelled_pages())


def test_main_text_of_other_labelled_pages(weights):
    """Pages made with another seed: few blocks are lost, few are added."""
    lost = added = total = 0
    for page, blocks in html_text.labelled_pages(200, seed=11):
        got, want = Counter(html_text.extract(page, weights).split("\n")), Counter(" ".join(b.split()) for b in blocks)
        lost, added, total = lost + (want - got).total(), added + (got - want - Counter([""])).total(), total + want.total()
    assert lost < 0.1 * total and added < 0.1 * total
    assert weights.of["in kind talk"] + weights.of["in comments"] < 0 < weights.of["tag article"] and max(weights.tags.values()) < 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Story one para.</p><div class='more'><p>rest of the story here.</p></div></article>", "Story one para.\nrest of the story here."),
        ("<nav><a href=x>Home</a></nav><div class='share-story'><h1>A title here</h1><p>First paragraph of the story is here.</p></div><div class='story-body'><p>Second paragraph of words, more words.</p></div>", "A title here\nFirst paragraph of the story is here.\nSecond paragraph of words, more words."),
        ("<nav><a href=x>Home</a></nav><article class='comments-enabled story-text'><p>Whole article text is here and goes on.</p></article><div>other words</div>", "Whole article text is here and goes on."),
        ("<article><h1>T</h1><p>Text one.</p><div class=ad>buy now</div><p>Text two.</p><div class=comments><p>I think that this is a really nice article, thanks a lot to you.</p></div></article>", "T\nText one.\nText two."),
    ],
)
def test_names_do_not_decide_alone(weights, page, want):
    assert html_text.extract(page, weights) == want


@pytest.mark.parametrize("piece", ["<div ", '<div "', "</div>", "<p><b>", "<!", "<script>", "<a", "<div>", "<li><p>x", "<div class='a'>x "])
def test_main_text_is_linear(weights, piece):
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.extract(piece * n, weights)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 20 * seconds(4_000) + 0.5


def test_main_text_of_long_pages(spark, weights):
    words_ = " ".join(f"w{i}" for i in range(50_000))
    assert html_text.extract(f"<article><p>{words_}</p></article>", weights) == words_
    assert html_text.extract("<p>some text here</p>" + "<div " * 20_000, weights) == "some text here"
    assert spark.createDataFrame([], "page_id bigint, url string, html string").transform(html_text.report).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def test_mixing_targets_and_cuts(docs, rows):
    got = mixing.mix(crowded(docs, "src", "key", "size", "slice")).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s))
    total, w = sum(size.values()), {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = sum(w[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * w[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == math.floor(target[s] + 0.5)
    assert same(mixing.mix(docs.repartition(7))) == same(mixing.mix(docs))


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------


def line_brute(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    last = {k: max(v, key=lambda d: -1 if d is None else d) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if last.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(docs, rows):
    assert same(line_dedup.report(crowded(docs, "doc", "th", "kept", "k1"))) == line_brute([r[:2] for r in rows])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_line_dedup_hot_line_over_partitions(spark, parts):
    hot, warm = "the hottest line of all, held by every single document", "a line that only four documents hold, so it stays there"
    rows = [(i, f"{hot}\nown line {i} that is long enough to count as a key\n{hot}" + (f"\n{warm}" if i < 4 else "")) for i in range(60)]
    rows += [(None, hot), (60, hot), (60, hot)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert same(line_dedup.report(d)) == line_brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_dedup_stream_at_partition_ends():
    """However a sorted list of rows is cut, the decisions and what is left open give the same drops."""
    import pyarrow as pa

    rows = [(k, 0, d, 0, 1, b"p") for k, n in ((1, 9), (2, 4), (3, 1), (4, 12)) for d in range(n, 0, -1)]
    want = {(r[0], r[2]) for r in rows if r[0] in (1, 4) and r[2] < {1: 9, 4: 12}[r[0]]}
    names = ["k1", "k2", "doc", "th", "n_lines", "pos"]
    for a in range(0, len(rows), 3):
        for b in range(a, len(rows) + 1, 4):
            out = []
            for part in (rows[:a], rows[a:b], rows[b:]):
                batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part])] if part else []
                out += [r for x in line_dedup._decide(iter(batches), 5) for r in x.to_pylist()]
            n, top = Counter(), {}
            for r in out:
                if r["kind"] > 0:
                    n[r["k1"]] += r["n_docs"]
                    top[r["k1"]] = max(top.get(r["k1"], 0), r["doc"])
            got = {(r["k1"], r["doc"]) for r in out if r["kind"] == 0 or (r["kind"] == 1 and n[r["k1"]] >= 5 and r["doc"] < top[r["k1"]])}
            assert got == want, (a, b)


def test_line_dedup_keeps_columns(docs, rows):
    out = line_dedup.deduplicated(crowded(docs, "doc", "th", "new"))
    assert out.columns == [*docs.columns, "doc", "th", "new"] and out.count() == len(rows)
    assert [r.text for r in out.where("doc_id = 300").collect()] == [None]


def test_line_dedup_empty(empty):
    assert line_dedup.report(empty).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        t = [f"wort{rng.randrange(200)}" for _ in range(rng.randrange(5, 120))]
        y = int(i % 6 == 0)
        for _ in range(3 * y):
            t.insert(rng.randrange(len(t)), rng.choice(["blarg", "gruftig", "zonk" + rng.choice("abcdefgh") * 2]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, y))
    rows += [(1000, None), (1001, ""), (None, "wort1 blarg"), (0, rows[0][1])]
    labels += [(2000, 1, None), (1, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)


def test_toxicity_held_out(labelled):
    d, lab = labelled
    got = toxicity.report(crowded(d, "score", "toxic", "y"), lab).collect()
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = toxicity.report(d.repartition(5), lab.repartition(2))
    assert same(again.selectExpr("doc_id", "round(score, 9)")) == sorted(((r.doc_id, round(r.score, 9)) for r in got), key=str)


def test_toxicity_doesnt_learn_from_held_out_labels(labelled):
    d, lab = labelled
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    flipped = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert same(toxicity.report(d, lab)) == same(toxicity.report(d, flipped))


def test_toxicity_without_labels(docs, labelled, empty):
    _, lab = labelled
    assert {r.score for r in toxicity.report(docs, lab.limit(0)).collect()} == {0.0}
    assert toxicity.report(empty, lab).count() == 0
    assert toxicity.accepted(docs, lab.limit(0)).count() == docs.count()


# --- near duplicates -----------------------------------------------------------------------------------------------


def components(rows):
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    smallest = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            smallest[i] = min(ids) if ids else None
    return sorted(((d, len(sets[i]), smallest[i], d == smallest[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_near_dedup(docs, rows):
    assert same(near_dedup.report(crowded(docs, "fp", "bands", "comp", "kept"))) == components([r[:2] for r in rows])


def test_near_dedup_chains_and_groups(spark):
    """Chains whose ends don't resemble, and a group whose members resemble only some of the others."""
    import random

    rng = random.Random(3)
    t = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(t)))
        for _ in range(2):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
    hub = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):
        x = list(hub)
        for _ in range(1 + i % 6):
            x[rng.randrange(len(x))] = f"m{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(x)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert same(near_dedup.report(d)) == components(rows)


def test_sketch_fills_and_estimates():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300, 5000):
        assert (near_dedup.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != np.uint64(2**64 - 1)).all()
    pool = rng.integers(0, 2**63, 1150).astype(np.uint64)
    a, b = near_dedup.sketch(pool[:1075], 1000), near_dedup.sketch(pool[75:], 1000)
    assert abs((a == b).mean() - 1000 / 1150) < 0.05


def test_near_dedup_kept_documents(docs, rows):
    kept = near_dedup.kept_documents(crowded(docs, "fp", "th"))
    want = Counter(r[0] for r in components([r[:2] for r in rows]) if r[3])
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == [*docs.columns, "fp", "th"]


def test_near_dedup_empty(empty):
    assert near_dedup.report(empty).count() == 0 and near_dedup.kept_documents(empty).count() == 0


# --- exact top-k ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def topk_brute(rows, every=50, k=5):
    import numpy as np

    good = [(i, [math.floor(float(np.float32(x)) * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        s = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:k]
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [4, 64, 8192])
def test_topk(spark, monkeypatch, shard):
    import random

    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(12)]) for i in range(300)]
    rows += [(300, None), (350, [None, 1.0]), (351, [float("nan")] * 12), (352, [float("inf")] * 12), (None, [1.0] * 12), (353, rows[7][1]), (354, rows[7][1]), (355, []), (356, [1.0] * 5), (400, [0.0] * 12)]
    monkeypatch.setattr(topk, "SHARD", shard)
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got = topk.report(crowded(d, "w", "score", "rank"))
    assert same(got) == topk_brute(rows)
    q = topk.quantised(d)
    assert same(topk.search(q, q.where("vec_id % 50 = 0"), 5, query_block=3)) == topk_brute(rows)


def test_topk_few_candidates(spark):
    d = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0)], VECTORS)
    assert same(topk.report(d)) == [(0, 1, 1, 256 * 128)]
    assert topk.report(d.limit(0)).count() == 0


# --- language model ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [50, 10**6])
def test_lm(docs, rows, block):
    toks = [[*words(r[1]), b"\n"] for r in rows]
    train = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1 for r in rows]
    c = Counter(w for t, y in zip(toks, train) if y for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], not y, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for r, t, y in zip(rows, toks, train)), key=str)
    got = lm.report(crowded(docs, "block", "train", "score"), block_tokens=block).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out and r.n_tokens < 3000]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one():
    """The mixture over all words and one unseen word, for histories seen and unseen."""
    import numpy as np

    text = "a b a c a b b c a b".split()
    pairs, uni = Counter(zip(text, text[1:])), Counter(text)
    n, types = len(text), len(uni)
    lam = lm.weights(np.array([0]), np.array([1]), types)
    for h in uni:
        ch = sum(k for (x, _), k in pairs.items() if x == h)
        total = 0.0
        for w in [*uni, None]:
            l2, l1, l0 = lam[lm._bucket(np.array([ch]))[0]]
            total += l2 * pairs[(h, w)] / ch + l1 * uni[w] / n + l0 / (types + 1)
        assert math.isclose(total, 1.0)


def test_lm_empty(spark, empty):
    assert lm.report(empty).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.report(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)
