"""Codebooks, probes and readouts: decoding tables, quality checks and assembly."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.columns import kmers, reverse_complement, share_of

# Enthalpy (kcal/mol) and entropy (cal/mol/K) of neighbouring bases, from published unified parameters for DNA.
NEIGHBOURS = {
    "AA": (-7.6, -21.3),
    "AT": (-7.2, -20.4),
    "TA": (-7.2, -20.4),
    "CA": (-8.5, -22.7),
    "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.0),
}
START, END_AT = (0.2, -5.7), (2.2, 6.9)


def _paired(table: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    turn = str.maketrans("ACGT", "TGCA")
    return table | {k[::-1].translate(turn): v for k, v in table.items()}


def melting(sequence: Column, salt: float = 50.0, strands: tuple[float, float] = (25.0, 25.0)) -> Column:
    """Melting temperature (Celsius) by nearest neighbours, with salt (mM) and strands (nM); other letters count as nothing."""
    both = _paired(NEIGHBOURS)
    letters = F.split(F.upper(sequence), "")
    pair = lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1))
    value = lambda x, k: F.coalesce(*[F.when(x == p, F.lit(v[k])) for p, v in both.items()], F.lit(0.0))
    ends = F.when(F.left(sequence, F.lit(1)).isin("A", "T"), 1).otherwise(0) + F.when(F.right(sequence, F.lit(1)).isin("A", "T"), 1).otherwise(0)
    steps = F.when(F.length(sequence) > 1, F.transform(F.sequence(F.lit(0), F.length(sequence) - 2), pair)).otherwise(F.array().cast("array<string>"))
    total = lambda k: START[k] + ends * END_AT[k] + F.aggregate(F.transform(steps, lambda x: value(x, k)), F.lit(0.0), lambda a, x: a + x)
    entropy = total(1) + 0.368 * (F.length(sequence) - 1) * math.log(salt / 1000)
    return 1000 * total(0) / (entropy + 1.987 * math.log((strands[0] - strands[1] / 2) * 1e-9)) - 273.15


def decoded(pairs: DataFrame, codebook: DataFrame) -> DataFrame:
    """Pairs (r1, r2) with the code of the codebook (code, r1, r2) in either order, null for pairs that are no code (controls)."""
    book = codebook.select("code", F.least("r1", "r2").alias("_a"), F.greatest("r1", "r2").alias("_b"))
    keyed = pairs.withColumn("_a", F.least("r1", "r2")).withColumn("_b", F.greatest("r1", "r2"))
    return keyed.join(book, ["_a", "_b"], "left").drop("_a", "_b")


def with_blanks(codebook: DataFrame, readouts: DataFrame, most: int | None = None) -> DataFrame:
    """The codebook and, as code ``blank1`` .. by pair, the readout pairs (readouts: r) that it does not use; ``most`` of them if given."""
    from quillspan.operators.sequences import unused_pairs

    used = codebook.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).distinct()
    free = unused_pairs(readouts.select(F.col("r").alias("code")), used)
    free = free.withColumn("_n", F.row_number().over(W.orderBy("a", "b")))  # bounded by the code table
    if most is not None:
        free = free.filter(F.col("_n") <= most)
    return codebook.select(F.col("code").cast("string").alias("code"), "r1", "r2").unionByName(free.select(F.concat(F.lit("blank"), "_n").alias("code"), F.col("a").alias("r1"), F.col("b").alias("r2")))


def specificity(probes: DataFrame, counts: DataFrame, id_: str, sequence: Column, k: int) -> DataFrame:
    """id, tm, gc and hits: the counts of the probe's k-mers and of their reverse complements, but for the last k-mer."""
    words = kmers(sequence, k)
    rows = probes.select(id_, F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("kmer"))
    both = rows.unionByName(rows.withColumn("kmer", reverse_complement(F.col("kmer")))).groupBy(id_, "kmer").agg(F.count("*").alias("_t"))
    hits = both.join(counts, "kmer").groupBy(id_).agg(F.sum(F.col("_t") * F.col("n")).cast("long").alias("hits"))
    return probes.select(id_, melting(sequence).alias("tm"), share_of(sequence).alias("gc")).join(hits, id_, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def between_probes(probes: DataFrame, id_: str, sequence: Column, k: int, most: int) -> DataFrame:
    """Probes whose k-mers, on both strands, occur at most ``most`` times among all probes (its own occurrences count), with the hits."""
    rows = probes.select(id_, F.explode(kmers(sequence, k)).alias("kmer"))
    counts = rows.groupBy("kmer").agg(F.count("*").alias("n"))
    both = rows.unionByName(rows.withColumn("kmer", reverse_complement(F.col("kmer")))).groupBy(id_, "kmer").agg(F.count("*").alias("_t"))
    hits = both.join(counts, "kmer").groupBy(id_).agg(F.sum(F.col("_t") * F.col("n")).cast("long").alias("hits"))
    return probes.select(id_).join(hits, id_, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))).filter(F.col("hits") <= most)


def good_readout(sequence: Column, gc: tuple[float, float] = (0.4, 0.6), run: int = 4, repeat: int = 6, c: tuple[float, float] = (0.22, 0.28), first: int = 12, most_c: int = 4) -> Column:
    """Whether a readout passes: GC share and share of C strictly inside their ranges, no base ``run`` times in a row, no repeated word of
    ``repeat`` letters, and fewer than ``most_c`` C in every word of ``repeat`` letters that starts in the first ``first - repeat``."""
    words = kmers(sequence, repeat)
    share, cs = share_of(sequence), share_of(sequence, "C")
    crowded = F.exists(F.slice(words, 1, first - repeat), lambda x: F.length(x) - F.length(F.translate(x, "C", "")) >= most_c)
    good = (share > gc[0]) & (share < gc[1]) & ~sequence.rlike("|".join(f"{b}{{{run},}}" for b in "ACGT"))
    return F.coalesce(good & (F.size(F.array_distinct(words)) == F.size(words)) & (cs > c[0]) & (cs < c[1]) & ~crowded, F.lit(False))


def adaptors(readouts: DataFrame, sites: DataFrame, kept: int = 20) -> DataFrame:
    """readout and adaptor of readouts(n, name, sequence) and sites(n, name, sequence), both numbered from 0: the last ``kept`` letters of the
    readout and twice the first ``kept`` of the site, sites taken in turn."""
    count = sites.agg(F.count("*").alias("_c"))
    s = sites.select(F.col("n").alias("_s"), F.col("name").alias("_site"), F.left("sequence", F.lit(kept)).alias("_letters"))
    both = readouts.join(F.broadcast(count)).withColumn("_s", F.pmod("n", "_c")).join(s, "_s")
    return both.select(F.concat("name", F.lit("_2x"), "_site").alias("name"), F.concat(F.right("sequence", F.lit(kept)), "_letters", "_letters").alias("adaptor"))


def region_sizes(probes: DataFrame, name: Column, least: int = 24) -> DataFrame:
    """region, n and whether it has more than ``least`` probes, of probe names that hold ``gene_<region>_``."""
    region = F.regexp_extract(name, "gene_([^_]*)", 1)
    return probes.select(region.alias("region")).groupBy("region").agg(F.count("*").alias("n"), (F.count("*") > least).alias("enough"))


def readout_usage(probes: DataFrame, name: Column) -> DataFrame:
    """region, readout and in how many probe names (``gene_<region>_ .. Stv_<n>_ .. NDB_<n>_``) the readout stands."""
    region = F.regexp_extract(name, "gene_([^_]*)", 1)
    found = F.regexp_extract_all(name, F.lit("((?:Stv|NDB)_[0-9]+)_"), 1)
    return probes.select(region.alias("region"), F.explode(found).alias("readout")).groupBy("region", "readout").agg(F.count("*").alias("n"))


def primers_fit(sequence: Column, forward: str, reverse: str, length: int = 20) -> Column:
    """Whether a probe begins with the forward primer and ends in the reverse complement of the last ``length`` letters of the other."""
    turn = str.maketrans("ACGT", "TGCA")
    return sequence.startswith(forward) & sequence.endswith(reverse[-length:][::-1].translate(turn))


def records_at(rows: DataFrame, order: str, wanted: list[int]) -> DataFrame:
    """The rows with the given places (from 0) in order: the records of a FASTA file by index."""
    from quillspan.sources.files import placed

    return placed(rows, [order]).filter(F.col("place").isin(wanted))


def slices_of(sequences: DataFrame, regions: DataFrame, name: str, flank: int, tile: int) -> DataFrame:
    """Pieces of ``tile`` letters of each region (name, region, start, end; half open), widened by ``flank`` and cut at the sequence's ends."""
    low = F.greatest(F.lit(0), F.col("start") - flank)
    both = regions.join(sequences, name).withColumn("_lo", low).withColumn("_hi", F.least(F.length("sequence"), F.col("end") + flank)).filter("_hi > _lo")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("_hi") - F.col("_lo") - 1) / tile)))
    cut = both.withColumn("piece", at)
    start = F.col("_lo") + F.col("piece") * tile
    return cut.select("region", "piece", start.alias("at"), F.substring("sequence", (start + 1).cast("int"), F.least(F.lit(tile), F.col("_hi") - start).cast("int")).alias("letters"))


def apart(candidates: DataFrame, by: list[str], slot: str, partner: str, score: str, tie: str) -> DataFrame:
    """By group: the best sum of scores of one candidate of slot 0 and one of slot 1 that do not share a partner (ties: least tie values)."""
    side = lambda k: candidates.filter(F.col(slot) == k).select(*by, F.col(tie).alias(f"c{k}"), F.col(partner).alias(f"_p{k}"), F.col(score).alias(f"_s{k}"))
    both = side(0).join(side(1), by).filter("_p0 <> _p1").withColumn("total", F.col("_s0") + F.col("_s1"))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round("total", 9)), "c0", "c1"))).filter("_r = 1").select(*by, "c0", "c1", "total")


def clamped(start: Column, end: Column, shift: Column, size: Column) -> tuple[Column, Column]:
    """A box side moved by the shift and held inside 0 .. size."""
    inside = lambda x: F.greatest(F.lit(0), F.least(x, size))
    return inside(start + shift), inside(end + shift)


def repeats_by_name(names: DataFrame, name: str) -> DataFrame:
    """key, first and second of names that differ only in the case of their first letter (``R12`` and ``r12``)."""
    rows = names.filter(F.lower(F.left(name, F.lit(1))) == "r").select(F.substring(F.col(name), 2, 1 << 20).alias("key"), F.col(name).alias("_n")).distinct()
    return rows.groupBy("key").agg(F.min("_n").alias("first"), F.max("_n").alias("second"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")


def readout_tags(text: Column) -> Column:
    """The readouts that a folder name ``H20R35,B`` lists: what follows its letter and number, split at commas."""
    return F.split(F.regexp_extract(text, "^.[0-9]*(.*)$", 1), ",")


def wanted(probes: DataFrame, sequence: Column, k: int) -> DataFrame:
    """The distinct k-mers of the probes, on both strands."""
    rows = probes.select(F.explode(kmers(sequence, k)).alias("kmer"))
    return rows.unionByName(rows.withColumn("kmer", reverse_complement(F.col("kmer")))).distinct()


def balanced_codes(regions: list[int], codes: list[tuple[int, int]], rounds: int, steps: int = 2000, seed: int = 0) -> tuple[dict[int, tuple[int, int]], float]:
    """A code (two rounds) for each region, numbered along its chromosome (``regions``: the chromosome of each), so that every chromosome's
    spots spread evenly over the rounds: hill-climbing by swaps, on the driver, for a design table.  Returns the codes and the greatest
    population deviation of the spots by round of a chromosome."""
    import random

    rng = random.Random(seed)
    order = list(codes)
    rng.shuffle(order)
    if len(order) < len(regions):
        raise ValueError("fewer codes than regions")
    load: dict[int, list[int]] = {c: [0] * rounds for c in regions}
    for c, code in zip(regions, order, strict=False):
        for r in code:
            load[c][r] += 1
    squares = lambda c: sum(x * x for x in load[c])  # noqa: E731  the mean is fixed, so the deviation falls with them
    for _ in range(steps):
        i, j = rng.randrange(len(regions)), rng.randrange(len(order))
        other = regions[j] if j < len(regions) else None
        if other == regions[i]:
            continue
        touched = [c for c in (regions[i], other) if c is not None]
        before = sum(map(squares, touched))

        def move(sign: int) -> None:
            for c, out, new in ((regions[i], order[i], order[j]), (other, order[j], order[i])):
                if c is not None:
                    for r in out:
                        load[c][r] -= sign
                    for r in new:
                        load[c][r] += sign

        move(1)
        if sum(map(squares, touched)) <= before:
            order[i], order[j] = order[j], order[i]
        else:
            move(-1)
    spread = lambda v: math.sqrt(sum((x - sum(v) / rounds) ** 2 for x in v) / rounds)
    return dict(enumerate(order[: len(regions)])), max(map(spread, load.values()))


def rounds_of(codebook: DataFrame) -> DataFrame:
    """Which regions (code) show in which round, of a codebook (code, r1, r2)."""
    return codebook.select(F.explode(F.array("r1", "r2")).alias("round"), "code")


def regions_of(codebook: DataFrame, rounds: DataFrame) -> DataFrame:
    """Every code (code, r1, r2) with the least region that shows in both of its rounds (round, region); null without one."""
    one, two = (rounds.select(F.col("round").alias(r), F.col("region")) for r in ("r1", "r2"))
    both = codebook.join(one, "r1").join(two, ["r2", "region"]).groupBy("code").agg(F.min("region").alias("region"))
    return codebook.join(both, "code", "left").select("code", "region")


def halved_rounds(rounds: DataFrame, chromosome: str, total: int) -> DataFrame:
    """Rounds (round, region) split in two: the regions of a chromosome in a round go in turn to it and to round + ``total``."""
    w = W.partitionBy("round", chromosome).orderBy("region")
    return rounds.withColumn("half", F.col("round") + total * ((F.row_number().over(w) - 1) % 2))


def unique_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both that share a key which the right side has once."""
    once = right.withColumn("_n", F.count("*").over(W.partitionBy(key))).filter("_n = 1").drop("_n")
    return left.join(once, key)


def tailed(probes: DataFrame, code: list[int], tails: list[str], limit: int = 10, cut: int = 15) -> DataFrame:
    """Probes of chained pairs with the tails of a gene's code, balanced over its bits.  probes: gene, pair, place (in its pair), sequence.

    The outer end of a chain's first and last probe takes the bit least used for outer ends, each inner end the bit least used for inner
    ones; a probe's left inner bit is the right one of the probe before it.  The result, from left to right, is the reverse complement
    of the left tail from ``cut`` on, of the probe, and of the right tail up to ``cut``; a gene is done when every bit has ``limit`` inner uses.
    What a probe gets depends on those before it: a grouped-map function over a gene."""
    turn = str.maketrans("ACGTacgt", "TGCAtgca")
    back = lambda s: s[::-1].translate(turn)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        outer, inner, out = [0] * len(code), [0] * len(code), []
        least = lambda used: used.index(min(used))
        for pair, chain in pdf.sort_values(["pair", "place"]).groupby("pair", sort=True):
            right = 0
            for k, (place, sequence) in enumerate(zip(chain["place"], chain["sequence"], strict=True)):
                kinds = ["v", "v"]
                if k == 0:
                    kinds[0] = "i"
                    left = least(outer)
                    outer[left] += 1
                    right = least(inner)
                else:
                    left = right
                    inner[left] += 1
                    if k == len(chain) - 1:
                        kinds[1] = "i"
                        right = least(outer)
                        outer[right] += 1
                    else:
                        right = least(inner)
                bits = [f"{kind}_{code[b]}" for kind, b in zip(kinds, (left, right), strict=True)]
                out.append((pdf["gene"].iloc[0], pair, place, *bits, back(tails[code[left]][cut:]) + back(sequence) + back(tails[code[right]][:cut])))
                if min(inner) >= limit:
                    return pd.DataFrame(out, columns=names)
        return pd.DataFrame(out, columns=names)

    names = ["gene", "pair", "place", "left", "right", "sequence"]
    kinds = dict(probes.dtypes)
    schema = f"gene {kinds['gene']}, pair {kinds['pair']}, place {kinds['place']}, left string, right string, sequence string"
    return probes.select("gene", "pair", "place", "sequence").groupBy("gene").applyInPandas(work, schema)
