"""Hard negatives, common lines and fill-in-middle against plain versions."""

import base64
import collections
import hashlib
import json
import random
import tracemalloc

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import annuli, chosen_path, langid, line_runs, middle, pii, tiling, warc
from quillspan.llm.words import mix


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def plain_negatives(rows, is_anchor, n_positives=5, n_negatives=3, least=50, most=95):
    """rows (vec_id, vector, label) that take part."""
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=False))
    first = lambda s: sorted(s, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, (anchor, x, label) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [(dot(x, y), j, other == label) for k, (j, y, other) in enumerate(rows) if k != i]
        for p, positive in [s[:2] for s in first(s for s in scored if s[2])][:n_positives]:
            hard = first(s for s in scored if not s[2] and least * p <= 100 * s[0] <= most * p)
            out += [(anchor, positive, rank, s[1], p, s[0]) for rank, s in enumerate(hard[:n_negatives], 1)]
    return out


def negatives_of(df):
    return [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


@pytest.mark.parametrize("options", [{}, {"block": 7, "anchors": 4, "n_pivots": 5}, {"block": 1, "anchors": 100, "n_pivots": 1}])
def test_hard_negatives(spark, options):
    random.seed(3)
    centre = [[random.randint(-20, 20) for _ in range(6)] for _ in range(6)]
    rows = [(i, [c + random.randint(-6, 6) for c in random.choice(centre)], random.randint(0, 2)) for i in range(150)]
    rows += [(200 + i, rows[0][1], i % 3) for i in range(12)]  # copies: ties
    rows += [rows[3], rows[10], rows[10]]  # repeated rows, one of them an anchor
    rows += [(None, rows[1][1], 1), (300, [0] * 6, 0), (310, [5, 5], 1), (320, [], 2), (330, [1] * 9, 0)]
    extra = [(400, None, 1), (410, [1] * 6, None), (420, [1, None, 3, 4, 5, 6], 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, vec array<long>, label long").withColumn("rank", F.lit("x")).withColumn("w", F.lit(1)).repartition(3)
    got = negatives_of(annuli.hard_negatives(df, F.col("vec_id") % 10 == 0, **options))
    assert len(got) > 100
    same(got, plain_negatives(rows, lambda i: i is not None and i % 10 == 0))


def test_hard_negatives_on_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, vec array<long>, label long")
    assert negatives_of(annuli.hard_negatives(empty, F.col("vec_id") % 10 == 0)) == []
    lone = spark.createDataFrame([(0, [1, 2], 1)], "vec_id long, vec array<long>, label long")
    assert negatives_of(annuli.hard_negatives(lone, F.col("vec_id") % 10 == 0)) == []
    rows = [(0, [2**27, 0], 1), (1, [2**27 - 1, 3], 1), (2, [2**27 - 2**24, 1], 2), (3, [2**27 - 2**24, 2], 2)]  # beyond exact floats
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, label long")
    same(negatives_of(annuli.hard_negatives(df, F.col("vec_id") == 0)), plain_negatives(rows, lambda i: i == 0))
    with pytest.raises(ArithmeticError):
        annuli.hard_negatives(spark.createDataFrame([(0, [2**40], 1)], "vec_id long, vec array<long>, label long"), F.col("vec_id") == 0)


def test_only_reachable_blocks_are_scanned(spark):
    """Far groups: the anchors of one group go to the blocks of their own and no others."""
    random.seed(4)
    rows = [(i, [1000 * ((i % 4) == j) + random.randint(0, 5) for j in range(4)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, label long").withColumn("anchor", F.col("vec_id") % 20 == 0)
    index = annuli.Index(df, n_pivots=4, block=20, anchors=64)
    queries = index.queries()
    first = index.search(queries, True, 2)
    assert first.count() == 40
    kth = first.filter("rank = 2").groupBy("ab").agg(F.collect_list(F.struct("q", "w", "score")).alias("best"))
    reach = spark.sparkContext.broadcast(index.reach)
    left = queries.join(kth, "ab").groupBy("ab").applyInArrow(annuli._planned(reach, 0, 4096, 1), "rb long, ab long, qs array<int>, rows array<long>, labels array<long>, vecs binary, floor array<long>, top array<long>")
    blocks = index.blocks.count()
    assert left.select(F.sum(F.size("qs"))).first()[0] < 0.5 * 20 * blocks


def test_vectors_are_never_broadcast(spark, monkeypatch):
    """A few blocks of anchors, small by their files, meet every block of rows: neither side may be sent to all tasks whole."""
    rows = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 11, F.lit(2**20) + F.col("id")).alias("vec"), (F.col("id") % 3).alias("label"))
    plans, write = [], annuli.written
    monkeypatch.setattr(annuli, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    plain = [(r.vec_id, r.vec, r.label) for r in rows.collect()]
    same(negatives_of(annuli.hard_negatives(rows, F.col("vec_id") % 50 == 0, block=64, anchors=4)), plain_negatives(plain, lambda i: i % 50 == 0))
    assert [name for name, _ in plans].count("annuli-found") > 2
    assert not [plan for _, plan in plans if "Broadcast" in plan]


def test_rows_that_take_part(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("-inf")], 1), (5, None, 1), (6, [1.0], None), (7, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(r.vec_id for r in df.filter(annuli.usable(F.col("label"), F.col("embedding"))).collect()) == [1, 7]


_BLANK = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_lines(rows, least_chars=40, least_docs=5):
    where = collections.defaultdict(list)
    of = [[line.strip(_BLANK).translate(_LOWER) for line in (t or "").split("\n")] for _, t in rows]
    for (doc, _), keys in zip(rows, of, strict=True):
        for k in {k for k in keys if len(k) >= least_chars}:
            where[k].append(doc)
    order = lambda d: (d is not None, d or 0)
    holder = {k: max(docs, key=order) for k, docs in where.items() if len(docs) >= least_docs}
    out = []
    for (doc, t), keys in zip(rows, of, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), keys, strict=True) if k not in holder or holder[k] == doc]
        out.append((doc, len(keys), len(keys) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    random.seed(9)
    common = [f"common line number {i} ÉÈ with enough characters to be a key" for i in range(12)]
    rows = []
    for i in range(120):
        some = random.sample(common, random.randint(0, 4))
        some = [random.choice([x, f"  {x.upper() if x.isascii() else x.replace('common', 'COMMON')}\t\r", x]) for x in some]
        own = [f"line {j} of document {i} that nobody else has in the table" for j in range(random.randint(0, 3))]
        all_ = some + own + ["short line", "", "   "]
        random.shuffle(all_)
        rows.append((i, "\n".join(all_)))
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n" + common[0] + "\n" + common[0] + "\n"), (None, common[1] + "\n" + common[2]), (None, None)]
    rows += [(7, rows[7][1])] * 3 + [(8, common[3])]  # repeated rows, and another text with an id that is there
    only_null = "a line that only rows without an id have, five of them"
    rows += [(None, only_null)] * 5
    rows += [(204, common[4] + "\n" + "x" * 200_000 + "\n" + "word " * 50_000), (205, "é" * 39), (206, "é" * 40)] + [(300 + i, "é" * 39 + "\n" + "é" * 40) for i in range(5)]
    rows += [(400, "\xa0" + common[5]), (401, common[6] + "\x85")]  # blanks that are not stripped
    return rows


@pytest.mark.parametrize("batches", [None, 1, 3])
def test_common_lines(spark, batches):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit(1)).withColumn("key", F.lit("k")).withColumn("batch", F.lit(2)).repartition(5)
    got = [tuple(r) for r in line_runs.remove_common(docs, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sum(r[2] for r in got) > 100
    same(got, plain_lines(rows))


def test_common_lines_of_an_empty_table(spark):
    assert line_runs.remove_common(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_merge_by_level(spark):
    """Each batch meets the runs before it: a key is new once, its first batch holds it, and counts add up."""
    random.seed(2)
    runs, total, holder = line_runs.LineRuns(spark, buckets=3), collections.Counter(), {}
    for i in range(7):
        batch = {random.randrange(60).to_bytes(2, "big"): random.randint(1, 4) for _ in range(25)}
        df = spark.createDataFrame([(k, n, 100 * i + n) for k, n in batch.items()], "key binary, n long, holder long")
        if i % 2 == 0:  # no second run of level 0 to merge with: the batch's own run is seen
            own = {bytes(r.key): r for r in spark.table(runs.add(df)).collect()}
            assert {k for k, r in own.items() if r.new} == batch.keys() - total.keys()
            assert all((r.holder is not None) == r.new for r in own.values())
        else:
            runs.add(df)
        for k, n in batch.items():
            total[k] += n
            holder.setdefault(k, 100 * i + n)
        assert [bool(x) for x in runs.levels] == [bool((i + 1) >> level & 1) for level in range(len(runs.levels))]
    plan = runs.spark.table(runs.runs()[0]).join(runs.spark.table(runs.runs()[1]).hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are not shuffled to be joined
    got = {bytes(r.key): (r.n, r.holder) for r in runs.compact().collect()}
    assert got == {k: (n, holder[k]) for k, n in total.items()}
    runs.close()


def plain_middle(doc, text, units, rate=90, spm=20):
    """Form, cut units and output of a text given in units."""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in middle.MARKS) or h3 % 100 >= rate:
        return (doc, len(units), "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, len(units), form, len(p), len(m), out)


def units_of(text, unit):
    """A unit begins with the text and: with each character, with each word after a blank, after each line end."""
    begins = {"char": lambda i: True, "word": lambda i: text[i] not in _BLANK and text[i - 1] in _BLANK, "line": lambda i: text[i - 1] == "\n"}[unit]
    cuts = [i for i in range(len(text)) if i == 0 or begins(i)]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)] if text else []


def middle_rows():
    random.seed(6)
    letters = "ab é中😀\n \t<>PSM"
    rows = [(i, "".join(random.choice(letters) for _ in range(random.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id at all"), (None, None), (1002, "x<P>y"), (1003, "<M>"), (1004, "<"), (1005, "a<P"), (1006, ">b"), (1007, "é"), (1008, "\0a\0"), (5, rows[5][1]), (5, "another text")]
    rows += [(2000 + i, "<" * i) for i in range(6)] + [(3000, "long text é " * 100_000), (3001, "中" * 300_000)]
    rows += [(4000, "<P"), (4001, ">")]  # no mark across two texts
    return rows


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_middle(spark, unit):
    rows = middle_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("n", F.lit("n")).withColumn("h1", F.lit(0)).coalesce(2)
    out = middle.restore(middle.transform(docs, unit=unit)).collect()
    want = [plain_middle(d, t or "", units_of(t or "", unit)) for d, t in rows]
    same([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out], want)
    same([(r.doc_id, r.restored) for r in out], [(d, t or "") for d, t in rows])
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table_and_marks(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert middle.restore(middle.transform(empty)).count() == 0
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = spark.createDataFrame(middle_rows(), "doc_id long, text string")
    out = middle.restore(middle.transform(docs, marks=marks, rate=100, spm=50, seed="s"), marks=marks).collect()
    same([(r.doc_id, r.restored) for r in out], [(d, t or "") for d, t in middle_rows()])
    assert all((r.form == "plain") == (not r.restored) for r in out)
    for bad in (("<P>", "<S>", "M"), ("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>"), ("é", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle.transform(docs, marks=bad)
    with pytest.raises(ValueError):
        middle.transform(docs, unit="page")


def test_many_spans_in_one_text(spark):
    """Spans of a long text are met and replaced by passes over it, as a plain loop would."""
    random.seed(8)
    some = [lambda i: f"a{i}.b@c{i}.org", lambda i: f'token = "aB3dE6gH1jK{i:05d}dLm9"', lambda i: f"10.0.{i % 256}.{i % 200}", lambda i: f"+1 (555) 010-{i % 10000:04d}", lambda i: f"call 555 123 {i % 10000:04d} and +1 555 123 {i % 10000:04d}"]
    text = " ".join(random.choice(["word é and", "x" * random.randint(1, 3000), "line\n", "中"]) + " " + random.choice(some)(i) for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, "")], "doc_id long, text string")
    model = pii.fit(docs)
    spans = [(x.start, x.end, x.kind, x.base) for x in pii.find(docs, model).filter("doc_id = 1").first().pii]
    base = [s for s in spans if s[3]]
    assert len(base) > 800 and len(spans) > len(base)
    assert not any(b[0] < x[1] and x[0] < b[1] for x in spans if not x[3] for b in base)
    want, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            want.append(f"{text[at:start]}[{kind.upper()}]")
        at = max(at, end)
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean == {1: "".join(want) + text[at:], 2: "x", 3: ""}


def test_tiles_are_the_longest(spark):
    """Tiles in their order against a search of all places, for few different words."""
    random.seed(12)
    for _ in range(400):
        words = random.choice([1, 2, 3, 6])
        a = [random.randrange(words) for _ in range(random.randint(0, 40))]
        b = [random.randrange(words) for _ in range(random.randint(0, 25))]
        k, want = random.randint(1, 5), []
        free_a, free_b = [True] * len(a), [True] * len(b)
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < k:
                break
            want.append((i, j, n))
            free_a[i : i + n] = free_b[j : j + n] = [False] * n
        assert tiling.tile(words_mix(a), words_mix(b), k) == want


def words_mix(x):
    return mix(np.array(x, np.uint64)) if x else np.zeros(0, np.uint64)


def test_repetitive_texts_are_tiled_in_linear_memory(spark):
    """A million equal words against items of equal words: no list of pairs of places."""
    one = words_mix([7] * 1_000_000)
    tracemalloc.start()
    assert tiling.tile(one, words_mix([7] * 3000), 5) == [(0, 0, 3000)]
    period = np.tile(words_mix([1, 2, 3]), 300_000)
    assert tiling.tile(period, words_mix([1, 2, 3] * 200 + [9] + [2, 3, 1] * 100), 5) == [(0, 0, 600), (601, 601, 300)]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    text, item = "again " * 200_000, "again " * 500
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(9, "again " * 249), (10, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(i, item) for i in range(4)], "item_id long, text string")
    for bound in (1 << 20, 0):
        same([(r.doc_id, r.item_id, r.covered) for r in tiling.contaminated(docs, items, bound=bound).collect()], [(d, i, 500) for d in range(3) for i in range(4)])


def test_langid_is_the_plain_classifier(spark):
    """Languages, cosines and rejections of every row against plain TF-IDF vectors, clusters and nearest centroids."""
    random.seed(21)
    sounds = {"xx": ["ae", "io", "u", "ra"], "yy": ["kl", "tm", "no", "ra"], "zz": ["éü", "ös", "ra", "ä"]}
    dialect = {"xx": ["q", "w"], "yy": ["v", "x"], "zz": ["ß", "ç"]}

    def text(lang, words, by=0.3):
        return " ".join("".join(random.choice(dialect[lang] if random.random() < by else sounds[lang]) for _ in range(random.randint(1, 4))) + random.choice(["", "", ".", " 12"]) for _ in range(words))

    rows = [(i, text(lang, random.randint(1, 40), random.choice([0.05, 0.8])), lang) for i in range(90) for lang in [random.choice(list(sounds))]]
    rows += [(100, rows[0][1], rows[0][2]), (101, rows[1][1].upper(), rows[1][2]), (102, None, "xx"), (103, "", "yy"), (104, "77 !", None), (105, "jjj hhh ggg", None), (106, "klklkl qqq ée", None), (107, "x", None), (108, "漢字", None)]
    train = [(t, lang) for i, t, lang in rows if i % 4 != 2]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(d.filter("doc_id % 4 <> 2").select("text", "lang"), size=512, longest=3, centroids=3, sample=10_000, reach=0.1, slack=0.01)
    got = {r.doc_id: r for r in model.predict(d, [F.col("doc_id")]).collect()}
    want = brute.languages(train, [t for _, t, _ in rows], 512, 3, 3, 0.1, 0.01)
    assert sum(w[2] for w in want) > 5 and len({w[0] for w in want}) == 4
    for (i, _, _), (language, score, rejected) in zip(rows, want, strict=True):
        assert got[i].language == language and got[i].score == pytest.approx(score, abs=2e-5), i
        assert got[i].rejected == rejected, i


def foreign(kind, payload, *heads, id_="<urn:x>"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {id_}", *heads, f"Content-Length: {len(payload)}"]
    return b"\r\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Archives of others: digests by other methods or none, Latin-1 and folded headers, subfolders, one file."""
    sha = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    records = [
        foreign("resource", b"no digest", id_="<urn:1>"),
        foreign("resource", b"abc", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'abc').hexdigest()}", id_="<urn:2>"),
        foreign("resource", b"abc", f"WARC-Payload-Digest: sha1:{sha}", "WARC-Target-URI: http://a/é".encode("latin-1"), id_="<urn:3>"),
        foreign("resource", b"abc", "WARC-Payload-Digest: blake9:xyz", "WARC-Target-URI: http://b/", "\tand more", id_="<urn:4>"),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: odd\r\n\r\nabc", "Content-Type: application/http", f"WARC-Payload-Digest: sha-256:{base64.b32encode(hashlib.sha256(b'abc').digest()).decode()}", id_="<urn:5>"),
    ]
    folder = tmp_path / "in"
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "a.warc").write_bytes(b"".join(records[:3]))
    (folder / "deep" / "er" / "b.warc").write_bytes(b"".join(records[3:]))
    (folder / "deep" / "notes.txt").write_text("no archive")
    read = lambda path: {r.record_id: r for r in warc.read_warc(spark, str(path), verify=True).collect()}
    got = read(folder)
    assert {k: bytes(r.payload) for k, r in got.items()} == {"<urn:1>": b"no digest", **{f"<urn:{i}>": b"abc" for i in range(2, 6)}}
    assert [got[f"<urn:{i}>"].target_uri for i in (3, 4)] == ["http://a/é", "http://b/ and more"]
    assert got["<urn:1>"].payload_digest is None and got["<urn:3>"].payload_digest == sha and got["<urn:2>"].payload_digest.startswith("sha256:")
    assert read(folder / "a.warc").keys() == {"<urn:1>", "<urn:2>", "<urn:3>"}
    (tmp_path / "bad.warc").write_bytes(foreign("resource", b"abd", f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'abc').hexdigest()}"))
    with pytest.raises(Exception, match="another digest"):
        read(tmp_path / "bad.warc")
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n")
    with pytest.raises(Exception, match="no length"):
        read(tmp_path / "cut.warc")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_roll(spark, tmp_path, compression):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html")).coalesce(2)
    folder = str(tmp_path / compression)
    warc.write_warc(pages, folder, compression=compression, file_bytes=2_000)
    names = json.loads((tmp_path / compression / "_manifest.json").read_text())
    assert len(names) > 10 and sum(x["records"] for x in names) == 200
    assert max((tmp_path / compression / x["path"]).stat().st_size for x in names) < 4_000
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, folder, verify=True).collect()}
    assert back == {i: str(i) * 200 for i in range(200)}


def test_mixed_buckets_are_split(spark):
    """Texts that share half of their words and no more: one bucket for all until it is split; near copies among them are all found."""
    random.seed(31)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, f"{shared} {' '.join(word() for _ in range(60))}") for i in range(260)]
    for i in range(60):
        w = rows[i][1].split()
        w[random.choice([100, 110, 3])] = "other"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, f"{' '.join(word() for _ in range(3))} {rows[0][1]}") for i in range(60)]
    links, classes = brute.classes(rows)[1], brute.classes(rows)[0]
    names = {}
    for (d, _), c in zip(rows, classes, strict=True):
        names[c] = min(names.get(c, d), d)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"block": 40, "small": 8}, {"block": 100_000, "small": 8}):
        got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.near_duplicates(d, **options).collect()}
        assert got == {doc: (names[c], n) for (doc, _), c, n in zip(rows, classes, links, strict=True)}
    assert chosen_path.runs_needed(0.8, [0.8] * 3, 64, 0.999) < chosen_path.runs_needed(0.8, [0.8] * 3 + [0.5] * 6, 64, 0.999) < 24
