"""The operators against plain versions, on a small table with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import collections
import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quillspan.llm import chat, chosen_path, components, langid, packing, pii, quality_rules, records, superkmer, tiling, token_ids, warc
from quillspan.llm.queries import tokenizer_path
from quillspan.llm.shared import shared_folder
from quillspan.llm.token_ids import Encoder
from quillspan.llm.words import Words

random.seed(5)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(200)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [prose(random.randint(20, 120)) for _ in range(30)]
    shared = prose(60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:5])]  # copies
    for i in range(5, 15):  # near copies
        w = base[i].split()
        w[random.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(20) + " " + shared + " " + prose(15)) for i in range(6)]
    rows += [(400, None), (401, ""), (None, "a b"), (None, None), (402, " \n\t "), (403, "a b c d"), (404, "a b c d"), (405, "x " * 300), (406, "y" * 5000), (407, prose(3000)), (3, base[3]), (3, "other text with the same id as before"), (408, "é ü　中文 it's  a\x85b")]
    return rows


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("n_words"), F.lit(2).alias("_words"), F.lit("z").alias("kept"), F.lit(3).alias("k"), F.lit(4).alias("pii")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_encoder_is_the_library(library):
    odd = ["a  b", "a \n b'll  ", "  x\t\ty 　z\x1c w 's it's \x85 k <|endoftext|> 12ab_! ", "", "\n\n", "中文 текст", "x\r\n\r\n  y", None, " ", " a", "a ", "x" * 5000, " " * 500, "￿ a"]
    odd += ["".join(random.choice("ab '\n\t1.! é\x1csl") for _ in range(40)) for _ in range(500)]
    for encoder in (Encoder(tokenizer_path()), Encoder(tokenizer_path(), memo=50, chunk=300)):
        for text, ids in zip(odd, encoder.encode(odd), strict=True):
            assert ids.tolist() == library(text), repr(text)
    a, b = twins()  # one hash under powers of one number
    x, y = Encoder(tokenizer_path()).encode([a, b])
    assert x.tolist() == library(a) and y.tolist() == library(b)


def test_encoder_compares_pieces(library, monkeypatch):
    monkeypatch.setattr(token_ids, "_PLACE", np.zeros_like(token_ids._PLACE))  # all pieces of one length share a hash
    odd = ["ab cd ab xy", "it's cd don't", "cd ab " * 9, "x" * 70 + " " + "y" * 70]
    encoder = Encoder(tokenizer_path())
    for _ in range(2):
        for text, ids in zip(odd, encoder.encode(odd), strict=True):
            assert ids.tolist() == library(text), repr(text)


def test_packing(docs, empty, library):
    got = packing.pack(docs, tokenizer_path(), size=64).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    want = collections.Counter((d, len(library(t)) + 1) for d, t in ROWS)
    have = collections.Counter()
    for (d, n), rs in pieces.items():
        assert sum(r.length for r in rs) % n == 0
        have[d, n] += sum(r.length for r in rs) // n
        assert all(len(r.ids) == 4 * r.length for r in rs)
    assert have == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length, r.padded_to))
    filled = padded = 0
    for w in windows.values():
        at = 0
        for offset, length, _ in sorted(w):
            assert offset == at
            at += length
        assert at <= 64 and w[0][2] == (at if at & (at - 1) == 0 else 64)
        filled, padded = filled + at, padded + w[0][2]
    assert filled > 0.97 * padded
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize(("size", "unit"), [(64, 1), (64, 4), (10, 1)])
def test_packing_places_as_the_plain_packer(spark, library, size, unit):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(d, tokenizer_path(), size=size, unit=unit).collect()
    ids = {i: [*library(t), 1] for i, t in rows}
    have = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids == np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        have[r.sequence_id].append((r.doc_id, r.start, r.length))
    want = brute.packed([(i, len(x)) for i, x in ids.items()], size, unit)
    by_fill = lambda all_: sorted(sorted(w) for w in all_)
    rule = [s for s, how in {r.sequence_id: r.closed for r in got}.items() if how in ("front", "rule")]
    assert by_fill(have[s] for s in rule) == by_fill(want[: len(rule)])
    assert sum(map(len, have.values())) <= len(rows) + len(have) and len(have) == len(want)
    assert unit > 1 or all(sum(n for *_, n in have[s]) == size for s in rule)


def test_sum_of_squares_takes_the_least():
    random.seed(1)
    for unit in (1, 3):
        p = packing.SumOfSquares(20, unit)
        for _ in range(300):
            n = random.randint(1, 19)
            fills = [f for level in p.open for f, _ in level]

            def cost(f):
                return sum(c * c for c in collections.Counter(x // unit for x in f if 20 - x >= unit).values())

            tries = [cost([*fills, n])]
            for level in p.open:
                if level and level[-1][0] + n <= 20:
                    f = list(fills)
                    f.remove(level[-1][0])
                    tries.append(cost([*f, level[-1][0] + n]))
            p.place(0, n)
            assert cost([f for level in p.open for f, _ in level]) == min(tries)


def test_records(spark, docs, empty, library):
    folder = shared_folder(spark, "t")
    records.write_records(docs, folder, tokenizer_path(), parts=3)
    got = records.read_records(spark, folder).collect()
    assert len(got) == len(ROWS)
    got.sort(key=lambda r: r.start)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    same([(r.doc_id, r.ids) for r in got], [(d, np.array([*library(t), 0], "<u4").tobytes()) for d, t in ROWS])
    orders = [records.read_shuffled(spark, folder, seed).collect() for seed in (1, 1, 2)]
    same([tuple(r)[:4] for r in orders[0]], [tuple(r) for r in got])
    assert orders[0] == orders[1] and [r.place for r in orders[2]] == list(range(len(got)))
    assert [r.start for r in orders[0]] != [r.start for r in orders[2]] != sorted(r.start for r in got)
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(records.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    folder = shared_folder(spark, "t")
    records.write_records(docs, folder, tokenizer_path(), file_bytes=2000)
    same([tuple(r) for r in records.read_records(spark, folder).collect()], [tuple(r) for r in got])
    folder = shared_folder(spark, "t")
    records.write_records(empty, folder, tokenizer_path())
    assert records.read_records(spark, folder).count() == 0 == records.read_shuffled(spark, folder, 1).count()


def test_damage_is_seen():
    import io

    data = bytearray(records.frame(b"payload"))
    assert records.unframe(io.BytesIO(bytes(data)).read) == b"payload"
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)).read)


def twins(n=2048):
    """Two words of n letters that powers of one number modulo 2**64 cannot tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_word_hashes_and_exact_numbers(monkeypatch):
    odd = [*twins(), "z" * 100_000, "z" * 99_999 + "y", "ab", "ab", "é" * 30]
    alone = [Words(pa.array([w])).hash[0] for w in odd]
    w = Words(pa.array([" ".join(odd[:4]), None, " \n".join(odd[4:])]))
    assert w.hash.tolist() == alone and len(set(alone)) == len(set(odd))
    monkeypatch.setattr(Words, "_hash", lambda self, data: np.zeros(len(self.start), np.uint64))
    number = Words(pa.array([" ".join(odd)])).exact().tolist()
    assert len(set(number)) == len(set(odd)) and number[4] == number[5]


@pytest.mark.parametrize("part", [4000, 1, 3])
def test_superkmer(docs, empty, part):
    want = [(d, *x) for (d, _), x in zip(ROWS, brute.repeats([t for _, t in ROWS], 35), strict=True)]
    assert sum(x[2] for x in want) > 500
    same([tuple(r) for r in superkmer.remove_repeats(docs, part=part).collect()], want)
    if part == 1:
        assert superkmer.remove_repeats(empty).count() == 0


def test_superkmer_compares_words(spark, monkeypatch):
    a, b = twins()
    rows = [(1, " ".join([a] * 35)), (2, " ".join([b] * 35)), (3, "x y " * 40), (4, "y x " * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, *x) for (i, _), x in zip(rows, brute.repeats([t for _, t in rows], 35), strict=True)]
    same([tuple(r) for r in superkmer.remove_repeats(d).collect()], want)
    # windows of one hash are told apart by their words
    texts = [t for _, t in ROWS if t]
    words = Words(pa.array(texts))
    hashes, where = words.grams(5)
    for h in (hashes, np.zeros_like(hashes), hashes % np.uint64(3)):
        order, alike = superkmer._clusters(words, h, where, np.zeros(len(h), np.int64), 5)
        got = collections.Counter(np.bincount(np.cumsum(~alike)[np.argsort(order)]).tolist())
        want = collections.Counter(collections.Counter(tuple(t.split()[i : i + 5]) for t in map(lambda x: " ".join(brute.words(x)), texts) for i in range(len(t.split(" ")) - 4)).values())
        got.pop(0, None)
        assert got == want


@pytest.mark.parametrize("options", [{}, {"block": 2, "small": 2}, {"block_shingles": 150}])
def test_chosen_path(docs, empty, options):
    label, links = brute.classes(ROWS)
    ids = collections.defaultdict(list)
    for (d, _), c in zip(ROWS, label, strict=True):
        ids[c].append(d)
    want = [(d, min((x for x in ids[c] if x is not None), default=None), n) for (d, _), c, n in zip(ROWS, label, links, strict=True)]
    same([(r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_duplicates(docs, **options).collect()], want)
    if "block" in options:
        assert chosen_path.near_duplicates(empty).count() == 0
        odd = docs.select("*", *[F.lit(1).alias(c) for c in ("n", "KD", "kh", "class_id", "_n")])
        kept = chosen_path.keep_one(odd)
        assert kept.columns == odd.columns
        alone = {(d, t) for d, t in ROWS if not brute.words(t)}  # no words: once for each doc_id and text
        assert kept.count() == len({c for c, (_, t) in zip(label, ROWS, strict=True) if brute.words(t)}) + len(alone)


def test_chosen_path_counts_many_near_copies(spark):
    """600 near copies that all differ, in several runs of rows: links and class against plain counting; words of one old hash."""
    base = prose(60).split()
    rows = [(i, " ".join(base[:3] + [f"w{i}"] + base[4 : 40 + i % 21])) for i in range(600)]
    d = spark.createDataFrame(rows + [(1000, f"{twins()[0]} b c d e f"), (1001, f"{twins()[1]} b c d e f")], "doc_id long, text string")
    label, links = brute.classes(rows)
    got = {r.doc_id: r for r in chosen_path.near_duplicates(d, block=256).collect()}
    assert [got[i].n_links for i, _ in rows] == links and sum(links) > 50_000
    assert [got[i].class_id for i, _ in rows] == [min(j for j, c in enumerate(label) if c == label[i]) for i, _ in rows]
    assert got[1000].n_copies == got[1001].n_copies == 1 and got[1000].n_links == 0


def test_chosen_path_recall(spark):
    """1,000 pairs of texts with a similarity of 0.8 to 0.9: nearly all are found."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(1000):
        w = [word() for _ in range(100)]
        n = rng.randint(5, 10)  # (96 - n) / (96 + n) is 0.90 to 0.81
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-n] + [word() for _ in range(n)]))]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got) / len(got)
    assert found >= 0.995, found


def test_components(spark):
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(130)] + [(900, 900)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.component for r in components.components(df).collect()}
    assert one == {r.node: r.component for r in components.components(df, bound=0).collect()}
    assert all(one[a] == one[b] for a, b in edges if a != b) and all(one[c] == c for c in one.values())


def test_tiling(spark, docs, empty):
    item = prose(40)
    w = item.split()
    more = [(1, "zz " + " ".join(w[20:] + ["qq"] + w[:20])), (2, prose(50)), (None, item.upper() + "!"), (3, " ".join(w[:15])), (2, None)]
    d = spark.createDataFrame(more, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "a b"), (7, item)], "item_id long, text string")
    for bound in (1 << 20, 0):
        got = tiling.contaminated(d, items, bound=bound).collect()
        same([(r.doc_id, r.item_id, r.covered) for r in got], [(1, 7, 40), (1, 7, 40), (None, 7, 40), (None, 7, 40)])
        clean = tiling.decontaminate(docs.unionByName(d, allowMissingColumns=True), items, bound=bound)
        assert clean.columns == docs.columns and clean.count() == len(ROWS) + 3
        assert tiling.contaminated(empty, items, bound=bound).count() == 0
        odd = d.select("*", *[F.lit(1).alias(c) for c in ("kd", "KH", "_kd", "times", "t")])
        left = tiling.decontaminate(odd, items, bound=bound)
        assert left.columns == odd.columns and left.count() == 3
    assert tiling.contaminated(d, items.filter("false")).count() == 0
    one, two = np.array([1, 2, 3, 4, 5, 6, 9, 9, 9, 9, 3, 4, 5, 6, 7], np.uint64), np.array([1, 2, 3, 4, 5, 6, 7], np.uint64)
    assert tiling.tile(one, two, 3) == [(0, 0, 6)]  # of the second match only one item word is left


def test_tiling_against_plain_tiling(spark):
    """Random documents made of item pieces, in several scripts, both ways of finding seeds, against tiling by trying all matches."""
    letters = ["a", "b", "c", "é", "漢", "字", "ก", "д"]
    items = [(i, " ".join(random.choice(letters[: 4 + i % 5]) for _ in range(random.randint(3, 30)))) for i in range(25)] + [(None, "x y z a b c"), (4, "x, y; z—a b “c”")]
    rows = []
    for i in range(60):
        parts = [" ".join(brute.tiling_words(random.choice(items)[1])[:: random.choice([1, 1, -1])]) for _ in range(random.randint(1, 4))]
        rows.append((i, random.choice([" ", " - ", "。", "’ "]).join(parts)))
    rows += [rows[0], (None, rows[1][1]), (70, None), (71, "漢字" * 12)]
    items.append((30, "漢字漢字漢字"))
    want = []
    for d, t in rows:
        for i, x in items:
            n, covered = brute.tiled(t, x, 3)
            if n >= 3 and 2 * covered >= n:
                want.append((d, i, n, covered))
    assert len(want) > 50
    d, x = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 0):
        same([(r.doc_id, r.item_id, r.item_words, r.covered) for r in tiling.contaminated(d, x, k=3, bound=bound).collect()], want)


def test_quality(docs, empty):
    got = quality_rules.judge(docs.select("doc_id", "text")).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(d, *brute.base_counts(t)) for d, t in ROWS])
    assert quality_rules.judge(empty).count() == 0


def test_quality_lines(spark):
    good = "Here is a line of ordinary prose that ends as it should."
    bad = ["Home | News | Sport | Weather", "Accept cookies to go on reading this page now.", "BUY NOW AND SAVE", "one two three four five six seven eight nine ten"]
    rows = [(1, "\n".join([good, good[:-1] + " twice.", good + " Yes."])), (2, "\n".join([good, *bad])), (3, "Title\n" + good + " It goes on.")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), most_repeated=100).collect()}
    assert got[1].kept and got[1].lines_removed == 0
    assert not got[2].kept and got[2].lines_removed == 4 and got[2].clean_text == good
    assert got[3].kept
    left = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(5)), most_repeated=100)
    assert left.columns == ["doc_id", "text", "kept"] and left.count() == 2


def test_quality_lines_against_plain_rules(spark):
    odd = ["|", "»", "·", "a", "Über", "http://x.y/z", "www.a.b", "https://", "READ", "read more", "Mentions Légales", "it!", "###", "!!", "word.", "end.)", "\t", "$$", "\x0b", "l'eau", "7", "A1"]
    lines = [random.choice([" ", "  "]).join(random.choice(odd) for _ in range(random.randint(1, 26))) for _ in range(600)]
    lines += ["word " * 900 + "Please read more about it there.", "a | b | c | " + "so it goes on " * 30 + "and ends."]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.lines_removed for r in quality_rules.judge(d.withColumn("words", F.lit(0)).withColumn("Kept", F.lit("x"))).collect()}
    want = {i: int(bool(brute.words(t)) and brute.line_fails(t, quality_rules.PHRASES)) for i, t in enumerate(lines)}
    assert got == want and 100 < sum(want.values()) < 560 and got[600] == got[601] == 0


def test_pii(spark, docs, empty):
    parts = ["a", "@", "b.", "c", "1", "2", "255", ".", "+", "-", " ", "(", ")", "4111111111111111", "é", "_", "mail", "0"]
    rows = ROWS + [(1000 + i, "".join(random.choice(parts) for _ in range(random.randint(1, 50)))) for i in range(800)]
    rows += [(5000 + i, f'{prose(10)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(5)}') for i in range(30)]
    rows += [(6000 + i, f"{prose(5)} see /files/{hashlib.sha1(str(i).encode()).hexdigest()[:18]} {prose(5)}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(d)
    got = pii.find(d, model).select("doc_id", pii.told(F.filter("pii", lambda x: x["base"])).alias("b"), pii.told(F.col("pii")).alias("s")).collect()
    same([(r.doc_id, r.b) for r in got], [(i, brute.base_spans(t)) for i, t in rows])
    assert all("secret:" in r.s for r in got if 5000 <= (r.doc_id or 0) < 5030)
    assert not any("secret:" in r.s for r in got if 6000 <= (r.doc_id or 0))
    text = pii.redact(d, model).filter("doc_id = 5000").first().text
    assert '"[SECRET]"' in text
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_pii_added_spans(spark):
    """Added spans against a plain version, in texts with many matches; long letters before a digit; clashing names; EM on known votes."""
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    parts = ['token = "H"', "api_key: H", "see H", "/files/H", "call 427-555-5262", "phone: (427) 555 0101", "2024-01-05 12", "page 1234567", "ssn 123-45-6789,", "Dear Dr. Ann Smith,", "Mr March of", "regards Mrs. Eve", "é", "a@b.cc", "word", "B" * 90 + "7", "12.34.5.6"]
    fill = lambda: random.choice(parts).replace("H", random.choice(hexes))
    rows = [(i, random.choice([" ", "\n", "; "]).join(fill() for _ in range(random.randint(1, 9)))) for i in range(500)]
    rows += [(1000, " ".join(fill() for _ in range(3000))), (1001, None), (None, ""), rows[3]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("BASE", F.lit("b")).withColumn("_t", F.lit(2))
    model = pii.fit(d)
    assert set(model.weights) == {"secret", "number", "person"}
    found = pii.find(d, model)
    assert found.columns == [*d.columns, "pii"]
    patterns = {"secret": pii.SECRET, "number": pii.NUMBER, "person": pii.PERSON}
    got = [(r.doc_id, r.s) for r in found.select("doc_id", pii.told(F.col("pii")).alias("s")).collect()]
    same(got, [(i, brute.pii_spans(t, model, patterns)) for i, t in rows])
    told = " ".join(s for _, s in got)
    assert all(told.count(k) > 50 for k in ("secret", "number", "person"))
    # three good labelers and one that knows nothing
    votes = collections.Counter()
    for _ in range(4000):
        true = random.random() < 0.3
        say = lambda right: int(true if random.random() < right else not true)
        votes[say(0.9), say(0.85), say(0.8), random.choice([-1, 0, 1])] += 1
    p, share, prior = pii._expectation([(v, float(n)) for v, n in sorted(votes.items())])
    assert abs(prior - 0.3) < 0.12 and share[0][1][1] > 0.75 > 0.4 > share[0][0][1] and abs(share[3][1][1] - share[3][0][1]) < 0.1
    by = dict(zip(sorted(votes), p, strict=True))
    assert by[1, 1, 1, -1] > 0.8 and by[0, 0, 0, -1] < 0.2


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc(spark, compression):
    pages = [(i, f"http://a/{i % 3}", f"<p>{prose(30)}</p>") for i in range(20)]
    pages += [(50, "http://ä b\n/x", pages[3][2]), (2, None, pages[3][2]), (60, "u", None), (61, "u", ""), (None, "u", ""), (61, "u", ""), (62, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    by = collections.defaultdict(list)
    for i, _, h in pages:
        by[(h or "").encode()].append(i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        first = min(x for x in by[body] if x is not None)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, compression=compression).collect()], want)
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("payload", "sha", "k", "digest", "refers_to", "n", "first")])
    same([tuple(r) for r in warc.round_trip(odd).collect()], [tuple(r) for r in warc.round_trip(df).collect()])
    path = shared_folder(spark, "w")
    warc.write_warc(df, path, compression=compression)
    back = warc.read_warc(spark, path)
    assert back.filter("record_type = 'revisit'").count() == sum(x[3] == "revisit" for x in want)
    assert sorted(bytes(r.payload) for r in back.filter("record_type in ('response') and target_uri like 'http://a/1%'").collect()) == sorted(h.encode() for _, u, h in pages if u == "http://a/1")
    assert warc.round_trip(df.filter("false"), compression=compression).count() == 0


def test_warc_members_that_end_at_a_buffer():
    """A gzip member whose last input holds no data does not end the file."""
    import io

    noise = random.Random(2).randbytes(17_000)
    reader = warc.WarcReader({"path": "x"})
    for n in range(16_000, 16_420):
        data = b"".join(warc._member(warc._record(i, "u", p, "X", None, "2000-01-01T00:00:00Z")) for i, p in ((5, noise[:n]), (6, b"z")))
        members = warc._Members(io.BytesIO(data))
        assert [r[0] for r in reader._rows(members, lambda k: members.seek(k, 1))] == [5, 6]  # noqa: B023


def test_warc_rows_that_share_an_id(spark):
    pages = [(5, "b", "x"), (5, "a", "x"), (5, "a", "x"), (7, "a", "x"), (None, "a", "x"), (None, "a", "y"), (None, "b", "y"), (-(2**63), "a", "z"), (None, "a", "z"), (9, "a", "w"), (9, "a", "v")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    want = [(5, "response", None), (5, "revisit", 5), (5, "revisit", 5), (7, "revisit", 5), (None, "revisit", 5), (None, "response", None), (None, "revisit", None)]
    same(got, want + [(-(2**63), "response", None), (None, "revisit", -(2**63)), (9, "response", None), (9, "response", None)])


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_pushed_filters(spark, compression):
    df = spark.createDataFrame([(i, f"http://a/{i % 3}", f"<p>{i % 7}</p>") for i in range(20)] + [(30, None, "x")], "page_id long, url string, html string")
    path = shared_folder(spark, "w")
    warc.write_warc(df, path, compression=compression)
    back = warc.read_warc(spark, path, payload=False)
    rows = back.collect()
    for c in ("record_id", "record_type", "target_uri", "date", "payload_digest"):
        values = sorted({r[c] for r in rows if r[c] is not None})
        tests = [(F.col(c) == values[0], lambda x: x == values[0]), (F.col(c).isin(values[0], values[-1]), lambda x: x in (values[0], values[-1])), (F.col(c).startswith(values[0][:3]), lambda x: x is not None and x.startswith(values[0][:3])), (F.col(c).isNotNull(), lambda x: x is not None)]
        for pushed, plain in tests:
            want = [r for r in rows if plain(r[c])]
            assert want
            same(back.filter(pushed).collect(), want)
    assert back.filter("payload_digest like 'sha1:%'").count() == 0
    for text, plain in (("page_id = 3", lambda r: r.page_id == 3), ("page_id in (3, 9, 77)", lambda r: r.page_id in (3, 9)), ("refers_to = 2", lambda r: r.refers_to == 2), ("refers_to is not null", lambda r: r.refers_to is not None), ("page_id > 15 and record_type = 'response'", lambda r: r.page_id > 15 and r.record_type == "response")):
        same(back.filter(text).collect(), [r for r in rows if plain(r)])


def test_langid(spark, empty):
    sounds = {"xx": "aeiou", "yy": "kltmn", "zz": "éüöäs"}
    rows = [(i, " ".join("".join(random.choice(sounds[lang] + "r") for _ in range(random.randint(2, 8))) for _ in range(40)), lang) for i in range(300) for lang in [random.choice(list(sounds))]]
    rows += [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d.filter("doc_id % 4 <> 2"), sample=100)
    got = {r.doc_id: r for r in model.predict(d, [F.col("doc_id")]).collect()}
    held = [(i, lang) for i, _, lang in rows[:300] if i % 4 == 2]
    assert np.mean([got[i].language == lang for i, lang in held]) >= 0.98
    assert [(got[i].language, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    far = spark.createDataFrame([(1, "wvwvw qxqxq jjj")], "doc_id long, text string")
    assert model.predict(far, [F.col("doc_id")], reject=True).first().language == "und"
    none = langid.train(empty)
    assert none.predict(d, [F.col("doc_id")]).filter("language <> 'und'").count() == 0
    assert model.predict(empty, [F.col("doc_id")]).count() == 0


def test_langid_learns_every_language(spark):
    """A language of one text, often repeated, and ones with a single row; ties; extra columns; no letters."""
    rows = [(i, "le chat dort sur la table rouge", "fr", 1) for i in range(3000)] + [(5000 + i, "der hund " + prose(5), "de", 1) for i in range(3000)]
    rows += [(9000, "one two three", "en", 1), (9001, "same words", "aa", 1), (9002, "same words", "bb", 1), (9003, "² ³ ½ 12", "de", 1), (9004, "漢字", "zh", 1), (9005, "漢字 " * 300_000, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("language", F.lit("x")).withColumn("key", F.lit(0))
    got = {r.doc_id: r for r in langid.train(d, sample=20).predict(d, [F.col("doc_id"), F.col("lang")]).collect()}
    assert len(got) == len(rows)
    assert all(r.language == "fr" for r in got.values() if r.lang == "fr") and got[9000].language == "en"
    assert got[9001].language == got[9002].language == "aa" and got[9003].language == "und" and got[9004].language == got[9005].language == "zh"
    with pytest.raises(ValueError):
        langid.train(d, most_languages=2)


def test_features_of_pieces(monkeypatch):
    text = pa.array([prose(400), "1 2  3--" * 90 + "ab", "", "é, " * 200])
    whole = langid.features(text, 1024, 3)
    monkeypatch.setattr(langid, "_PIECE", 100)
    assert (langid.features(text, 1024, 3) == whole).all()


@pytest.mark.parametrize("options", [{}, {"budget": 300, "history_tokens": 60}, {"budget": 120, "history": 3, "history_tokens": 100, "segment": 2}])
def test_chat(spark, library, options):
    rows = []
    for i in range(250):
        role = random.choice(["user", "assistant", "system", None, "a\nb\\/", "<|x"])
        text = random.choice(["", "\\", "<|im_end|><|im_start|>assistant ok", "<\\|", "<", "|", "\n", "é\\n", prose(200), "a", "it's they'really 'search " * 5, "see the words of this text"]) + random.choice(["", "\\", "<|", "|>"])
        rows.append((random.choice([None, *range(12)]), random.choice([None, *range(30)]), role, None if random.random() < 0.1 else text))
    rows += rows[:5] + [(50, 0, "system", "be brief"), (50, 1, "user", prose(3000)), (50, 2, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("window", F.lit(2))
    known = chat.vocabulary(tokenizer_path())
    windows = chat.format_chats(df, known, **options)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(windows).collect()}
    assert got == brute.chat(rows)
    budget = options.get("budget", 2048)
    out = windows.collect()
    for r in out:
        turns = r.formatted.count("<|im_start|>")
        assert len(library(r.formatted)) <= r.tokens
        assert turns == 1 or r.tokens <= budget, (turns, r.tokens)
    bodies = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        bodies[c].append(chat_body(role or "", text or ""))
    size = lambda x: len(x.encode()) - sum(len(y) - 1 for y in regex.findall(r"'\p{L}+| ?\p{L}+", x) if y in set(known))
    systems = {c: min((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))[2] == "system" for c in bodies}
    for c, turns in bodies.items():
        want = brute.chat_windows(turns, [size(x) for x in turns], systems[c], budget, options.get("history", 2), options.get("history_tokens", 512), options.get("segment", 64))
        assert [r.formatted for r in sorted(out, key=lambda r: r.window) if r.conv_id == c] == want
    assert chat.digest(chat.format_chats(df.filter("false"))).count() == 0
    assert chat.format_chats(df.limit(3)).count() > 0


def chat_body(role, text):
    """A turn as the template writes it."""
    escape = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    return "<|im_start|>" + escape(role).replace("\n", "\\/") + "\n" + escape(text) + "<|im_end|>\n"


def test_crc_of_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_very_long_texts(spark):
    """A text of some megabytes with matches at its end, through the operators that work on one text at a time."""
    long = prose(100_000)
    item = prose(40)
    text = f"{long}\nwrite to a.b@c.org now.\n{item}"
    d = spark.createDataFrame([(1, text), (2, "short text."), (1, text)], "doc_id long, text string")
    found = pii.find(d, pii.fit(d)).filter("doc_id = 1").collect()
    at = text.index("a.b@c.org")
    assert len(found) == 2 and all([(x.start, x.end, x.kind) for x in r.pii if x.base] == [(at, at + 9, "email")] for r in found)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for bound in (1 << 20, 0):
        same([(r.doc_id, r.covered) for r in tiling.contaminated(d, items, bound=bound).collect()], [(1, 40), (1, 40)])
    same([(r.doc_id, r.n_words, r.n_repeat_words) for r in quality_rules.judge(d).collect()], [(i, *(brute.base_counts(t)[k] for k in (0, 4))) for i, t in ((1, text), (2, "short text."), (1, text))])
    pages = d.select(F.monotonically_increasing_id().alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    back = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.round_trip(pages).collect()}
    assert sorted(back.values()) == [(11, "response"), (len(text.encode()), "response"), (len(text.encode()), "revisit")]
    turns = d.filter("doc_id = 1").limit(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    got = chat.digest(chat.format_chats(turns, chat.vocabulary(tokenizer_path()))).first()
    assert (got.n_turns, got.loss_chars) == (1, len(text)) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    clean = pii.redact(d, pii.fit(d)).filter("doc_id = 1").first().text
    assert clean == text.replace("a.b@c.org", "[EMAIL]")
