"""Pair probes and readouts against the plain scans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.operators import probes

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def words(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def gc(s):
    return sum(c in "GC" for c in s) / len(s)


def scan(genes, length, k, share, repeats, background, most, index, apart):
    """The plain scan, gene by gene and place by place; a pair's first probe is masked."""
    out = []
    for gene, seq in genes:
        text, pair, member, recorded = list(seq), 0, 0, set()
        for at in range(len(seq) - 2 * length + 1):
            one, two = "".join(text[at : at + length]), "".join(text[at + length : at + 2 * length])
            if "N" in one + two or not all(share[0] <= gc(p) <= share[1] for p in (one, two)):
                continue
            if repeats is not None and any(repeats[w] for p in (one, two) for w in words(p, k)):
                continue
            if background is not None:
                a, b = sorted(sum(background[w] for w in words(p, k)) for p in (one, two))
                if not (a < min(most) and b < max(most)):
                    continue
            if index is not None:
                sums = []
                for p in (one, two):
                    c = Counter()
                    for w in words(p, k):
                        c.update(index.get(w, {}))
                    own = min(c, key=lambda g: (-c[g], g)) if c else None
                    sums.append({g: n for g, n in c.items() if g != own})
                over = lambda p, x: {g for g, n in sums[p].items() if n > apart[x]}  # noqa: B023, E731
                if min(len(over(0, 0) & over(1, 1)), len(over(1, 0) & over(0, 1))):
                    continue
            if at in recorded:
                member += 1
            else:
                pair, member = pair + 1, 2
                out.append((gene, pair, 1, at, seq[at : at + length]))
                recorded.add(at)
            out.append((gene, pair, member, at + length, seq[at + length : at + 2 * length]))
            recorded.add(at + length)
            text[at : at + length] = "N" * length
    return out


def sequences(rng, n):
    common = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(4)]
    out = []
    for g in range(n):
        s = "".join(rng.choice([rng.choice("ACGT") * rng.randint(1, 3), rng.choice(common)[: rng.randint(5, 30)]]) for _ in range(30))
        out.append((g, s[:60] + "N" * rng.choice([0, 2]) + s[60:]))
    return out + [(90, ""), (91, None), (92, "ACGT"), (93, "ACGT" * 30), (94, "A" * 50), (95, out[0][1])]


@pytest.mark.parametrize("with_tables", [False, True])
def test_pair_probes_are_the_scan(spark, with_tables):
    rng = random.Random(3)
    genes = sequences(rng, 14)
    k, length = 5, 9
    repeats = Counter(rng.choice(words(genes[1][1], k)) for _ in range(4)) if with_tables else None
    background = Counter(w for _, s in genes if s for w in rng.sample(words(s, k), min(30, max(0, len(s) - k + 1)))) if with_tables else None
    index = {}
    for g, s in genes:
        for w in words(s or "", k):
            index.setdefault(w, Counter())[g] += 1
    index = index if with_tables else None
    rules = ((0.2, 0.8), repeats, background, (5, 12), index, (1, 2))
    want = scan([(g, s or "") for g, s in genes], length, k, *rules)
    assert len(want) > 20 and (with_tables or max(x[2] for x in want) > 2)
    tables = {}
    if with_tables:
        tables["repeats"] = spark.createDataFrame(list(repeats.items()), "kmer string, n long")
        tables["background"] = spark.createDataFrame([(w, float(n)) for w, n in background.items()], "kmer string, n double")
        tables["index"] = spark.createDataFrame([(w, g, n) for w, c in index.items() for g, n in c.items()], "kmer string, other long, n long")
    df = spark.createDataFrame(genes, "gene long, sequence string")
    got = probes.pair_probes(df, length, k=k, gc=(0.2, 0.8), most=(5, 12), apart=(1, 2), **tables)
    assert sorted((r.gene, r.pair, r.member, r.place, r.probe) for r in got.collect()) == sorted(want)


def test_weighted_kmers(spark):
    rows = [(1, "ACGTAC", 2.0), (2, "ACGACG", 0.5), (3, "ACG", 9.0), (4, None, 1.0)]
    got = probes.weighted_kmers(spark.createDataFrame(rows, "id long, s string, w double"), "id", F.col("s"), 3, F.col("w"))
    want = Counter()
    for _, s, w in rows:
        for x in words(s or "", 3) if s and len(s) > 3 else []:
            want[x] += w
    assert {r.kmer: r.n for r in got.collect()} == dict(want)


def test_first_independent_is_the_scan(spark):
    rng = random.Random(5)
    for size in (2, 30):
        sets = {i: {rng.randrange(size * 6) for _ in range(rng.randint(1, 4))} | ({-1} if i % 9 == 4 else set()) for i in range(150)}
        kept, used = [], set()
        for i, s in sets.items():
            if not s & used:
                kept.append(i)
                used |= s
        df = spark.createDataFrame([(i, str(w)) for i, s in sets.items() for w in s], "rank long, word string")
        assert sorted(r.rank for r in probes.first_independent(df).collect()) == kept
    assert probes.first_independent(df.filter("false")).count() == 0
    chain = spark.createDataFrame([(i, str(w)) for i in range(30) for w in (i, i + 1)], "rank long, word string")
    assert sorted(r.rank for r in probes.first_independent(chain).collect()) == list(range(0, 30, 2))


def good(s, lowest, most, run, repeat, c):
    w = words(s, repeat)
    if not (lowest < gc(s) < most) or any(b * run in s for b in "ACGT") or len(set(w)) < len(w) or not c[0] < s.count("C") / len(s) < c[1]:
        return False
    return all(x.count("C") < 4 for x in w[: 12 - repeat])


def test_search_readouts_is_the_scan(spark):
    rng = random.Random(6)
    pool = [(i, "".join(rng.choice("ACGT") for _ in range(20))) for i in range(60)]
    pool += [(100 + i, pool[i][1]) for i in range(20)] + [(200 + i, pool[i][1][::-1].translate(COMPLEMENT)) for i in range(10)] + [(300, "ACGTACGTACGTACGTACGTACGTACGTACGT")]
    existing = [pool[3][1], "N" * 5]
    df = spark.createDataFrame(pool, "id long, sequence string")
    made = {(r.id, r.t): r.s for r in df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("id", "t", probes.extended(F.col("sequence"), F.concat_ws(":", F.col("id").cast("string"), F.col("t").cast("string")), 30).alias("s")).collect()}
    for (i, _), s in made.items():
        own = dict(pool)[i]
        assert len(s) == 30 and (s.endswith(own) and s[30 - len(own) - 1] in "AT" if len(own) < 30 else s == own[:30])
    assert len({made[1, t] for t in range(8)}) == 8
    canon = lambda s: {min(w, w[::-1].translate(COMPLEMENT)) for w in words(s, 11)}
    used = set().union(*(canon(s) for s in existing))
    want = []
    for i, _ in sorted(pool):
        for t in range(8):
            s = made[i, t]
            if good(s, 0.3, 0.7, 5, 6, (0.1, 0.4)) and not canon(s) & used:
                want.append((i, t, s))
                used |= canon(s)
                break
    assert 20 < len(want) < 90
    rules = {"gc": (0.3, 0.7), "run": 5, "c": (0.1, 0.4)}
    got = probes.search_readouts(df, 1000, 30, 8, 11, spark.createDataFrame([(s,) for s in existing], "sequence string"), **rules)
    assert [tuple(r) for r in got.collect()] == want
    few = probes.search_readouts(df, 7, 30, 8, 11, spark.createDataFrame([(s,) for s in existing], "sequence string"), **rules)
    assert [tuple(r) for r in few.collect()] == want[:7]


def test_search_readouts_goes_on_to_later_ids(spark):
    rng = random.Random(5)
    pool = [(i, "".join(rng.choice("ACGT") for _ in range(18))) for i in range(60)]
    df = spark.createDataFrame(pool, "id long, sequence string")
    rules = {"gc": (0.0, 1.0), "run": 30, "c": (0.0, 1.0)}
    first = df.filter("id < 40").select("sequence")  # of these all share words with existing
    got = [tuple(r) for r in probes.search_readouts(df, 2, 30, 2, 11, first, **rules).collect()]
    assert len(got) == 2 and got == [tuple(r) for r in probes.search_readouts(df.filter("id >= 40"), 2, 30, 2, 11, first, **rules).collect()]
