"""Queries of probe design; same conventions as the catalog, which they join."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import probes, sequences
from quillspan.plans.catalog import query, table
from quillspan.plans.wider import _DNA, _probes

_SPELT = "translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _spelt():
    """A text's letters spelt in four."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def _genes(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("gene"), _spelt().alias("sequence"))


@query(f"WITH p AS (SELECT p_size, {_DNA} AS s FROM part) SELECT kmer, round(sum(w), 6) AS n FROM (SELECT unnest(list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6))) AS kmer, p_size / 10.0 AS w FROM p WHERE length(s) > 6) GROUP BY 1")
def kmer_weights(spark, sf):
    """Words of the part names, by the sum of the parts' sizes as expression levels."""
    return probes.weighted_kmers(_probes(spark, sf), "p_partkey", F.col("s"), 6, F.col("p_size") / 10).select("kmer", F.round("n", 6).alias("n"))


_PAIRS = f"""g AS (SELECT item_id::BIGINT AS gene, {_SPELT} AS s FROM benchmark), b AS (SELECT kmer, sum(w) AS n FROM (SELECT unnest(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8))) AS kmer, p_size / 10.0 AS w FROM (SELECT p_size, {_DNA} AS s FROM part) WHERE length(s) > 8) GROUP BY 1),
c AS (SELECT gene, unnest(range(length(s) - 19)) AS place, s FROM g), p AS (SELECT gene, place, substr(s, place + 1, 20) AS probe FROM c),
w AS (SELECT gene, place, unnest(list_transform(range(1, 14), lambda i: substr(probe, i, 8))) AS kmer FROM p), h AS (SELECT gene, place, sum(n) AS n FROM w JOIN b USING (kmer) GROUP BY 1, 2),
i AS (SELECT kmer, gene AS other, count(*) AS n FROM (SELECT gene, unnest(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8))) AS kmer FROM g) GROUP BY 1, 2),
o AS (SELECT gene, place, other, n FROM (SELECT *, row_number() OVER (PARTITION BY gene, place ORDER BY n DESC, other) AS r FROM (SELECT w.gene, place, other, sum(i.n) AS n FROM w JOIN i USING (kmer) GROUP BY 1, 2, 3)) WHERE r > 1),
f AS (SELECT p.gene, p.place, probe, coalesce(h.n, 0) AS n FROM p LEFT JOIN h USING (gene, place) WHERE (length(probe) - length(translate(probe, 'GC', ''))) / 20.0 BETWEEN 0.3 AND 0.7),
x AS (SELECT a.gene, a.place, bool_or(a.n > 2 AND z.n > 4) AS one, bool_or(z.n > 2 AND a.n > 4) AS two FROM o a JOIN o z ON z.gene = a.gene AND z.other = a.other AND z.place = a.place + 20 GROUP BY 1, 2)
SELECT f.gene, f.place, f.probe AS first, r.probe AS second FROM f JOIN f r ON r.gene = f.gene AND r.place = f.place + 20 LEFT JOIN x ON x.gene = f.gene AND x.place = f.place WHERE least(f.n, r.n) < 40 AND greatest(f.n, r.n) < 90 AND NOT coalesce(x.one AND x.two, false)"""


def _rules(spark, sf) -> dict:
    """Background and index for words of eight letters of the benchmark's genes."""
    genes = _genes(spark, sf)
    own = sequences.kmer_rows(genes, "gene", F.col("sequence"), 8).groupBy("kmer", F.col("gene").alias("other")).agg(F.count("*").alias("n"))
    return {"k": 8, "background": probes.weighted_kmers(_probes(spark, sf), "p_partkey", F.col("s"), 8, F.col("p_size") / 10), "most": (40, 90), "index": own, "apart": (2, 4)}


@query(f"WITH {_PAIRS}")
def probe_pair_places(spark, sf):
    """Places of the benchmark's genes at which two probes side by side pass all rules."""
    return probes.pair_candidates(_genes(spark, sf), 20, **_rules(spark, sf))


@query()
def probe_pairs(spark, sf):
    return probes.pair_probes(_genes(spark, sf), 20, **_rules(spark, sf))


@query()
def readout_search(spark, sf):
    """Readouts made of the part names' letters, against the words of the benchmark."""
    pool = _probes(spark, sf).select(F.col("p_partkey").cast("long").alias("id"), F.left("s", F.lit(18)).alias("sequence"))
    existing = table(spark, sf, "benchmark").select(_spelt().alias("sequence"))
    return probes.search_readouts(pool, 200, 30, 8, 13, existing, gc=(0.3, 0.7), run=5, c=(0.1, 0.4))
