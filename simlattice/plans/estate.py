"""The flagship chain: records to distances to pairs, tree and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlattice.functions.text import classify_lineage, clean_set, combine, file_stem, mode_set, shingles
from simlattice.operators import pairs as P
from simlattice.operators import records as R
from simlattice.operators import structure as S
from simlattice.operators import vectors as V

WEIGHTS = {"purpose": 1.0, "prompt": 1.0, "capability": 1.0, "interface": 1.0}


@dataclass
class Estate:
    records: DataFrame
    blocks: DataFrame
    coverage: DataFrame
    functional: DataFrame
    lineage: DataFrame
    tree: DataFrame | None
    clusters: DataFrame | None


def vector_pairs(vectors: DataFrame) -> DataFrame:
    """(i, j, d) of all vectors: what a tree needs. Only for estates that a dense matrix holds."""
    from simlattice.functions.text import cosine_distance

    n = vectors.count()
    if n > S.MOST:
        raise ValueError(f"{n} records; a dense matrix of more than {S.MOST} is refused")
    a, b = vectors.select(F.col("id").alias("i"), F.col("v").alias("u")), vectors.select(F.col("id").alias("j"), "v")
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", cosine_distance(F.col("u"), F.col("v")).alias("d"))


def analyse(records: DataFrame, vectors: dict[str, DataFrame], weights: dict[str, float] | None = None, centring: bool = True, ridge: float = 5.0, structure: bool = True) -> Estate:
    """records (schema.RECORD and row_idx) and vectors, {"purpose" or "prompt": (agent_id, v)}, to distances, tree and clusters.

    Sentence vectors come in as a table: any encoder will do. With centring, the style of sources that twins show is removed.
    Distances are over pairs of records up to a dense matrix's size, more are refused: use the joins of operators.pairs.
    """
    weights = WEIGHTS | (weights or {})
    own = R.assign_ids(R.dedupe_copies(records)).cache()
    n = own.count()
    if n > S.MOST:
        raise ValueError(f"{n} records; a dense matrix of more than {S.MOST} is refused")
    ids = own.select(F.col("agent_id").alias("id"), "row_idx")
    rows = own.select(F.col("agent_id").alias("id"), "source", file_stem("source_path").alias("stem"), "row_idx")
    twins = P.twin_pairs(rows, "id", "stem", "source")
    blocks: dict[str, DataFrame] = {}
    present: dict[str, DataFrame] = {}
    for name, given in vectors.items():
        v = rows.join(V.unit_vectors(given, "agent_id", "v"), "id")
        if centring and not twins.isEmpty():
            v = V.remove_style(v, V.style_offsets(v, twins, ridge))
        present[name], blocks[name] = v.select("id"), vector_pairs(v)
    for name, items, idf in (("capability", clean_set("tools"), True), ("interface", mode_set("input_modes", "output_modes"), False)):
        sets = own.select(F.col("agent_id").alias("id"), F.explode(items).alias("item")).distinct()
        have = sets.select("id").distinct()
        near = P.weighted_set_distances(sets, n, use_idf=idf)
        every = have.select(F.col("id").alias("i")).join(F.broadcast(have.select(F.col("id").alias("j"))), F.col("i") < F.col("j"))  # at most a dense matrix
        present[name] = have
        blocks[name] = every.join(near, ["i", "j"], "left").select("i", "j", F.coalesce("d", F.lit(1.0)).alias("d"))
    joined = None
    for name, d in blocks.items():
        part = d.withColumnRenamed("d", name)
        joined = part if joined is None else joined.join(part, ["i", "j"], "full")
    every = ids.select(F.col("id").alias("i")).join(F.broadcast(ids.select(F.col("id").alias("j"))), F.col("i") < F.col("j"))  # at most a dense matrix
    joined = every.join(joined, ["i", "j"], "left")
    functional = joined.withColumn("d", combine({k: F.col(k) for k in blocks}, weights, 1.0)).cache()
    spark = records.sparkSession
    coverage = spark.createDataFrame([(k, (2 * blocks[k].count() + present[k].count()) / (n * n) if n else 0.0) for k in blocks], "block string, coverage double")
    grams = own.select(F.col("agent_id").alias("id"), shingles(F.concat_ws("\n", "purpose", "prompt")).alias("items"))
    lineage = P.similarity_join(grams, 0.1)
    tree = S.neighbour_joining(functional, ids) if structure else None
    clusters = S.hdbscan(functional, ids) if structure else None
    return Estate(own, joined, coverage, functional.select("i", "j", "d"), lineage, tree, clusters)


def nearest(estate: Estate, limit: int = 50) -> DataFrame:
    """(i, j, functional, lineage, relation): the nearest pairs, with how far their text is shared."""
    top = estate.functional.orderBy("d", "i", "j").limit(limit)
    shared = estate.lineage.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("similarity").alias("lineage"))
    out = top.withColumn("functional", 1 - F.col("d")).join(shared, ["i", "j"], "left").withColumn("lineage", F.coalesce("lineage", F.lit(0.0)))
    return out.select("i", "j", F.round("functional", 3).alias("functional"), F.round("lineage", 3).alias("lineage"), classify_lineage(F.col("lineage"), F.col("functional"), 0.3, 0.6).alias("relation"))


def hashed_vectors(docs: DataFrame, id_col: str, text: str, width: int = 64) -> DataFrame:
    """(agent_id, v): hashed bags of words at length 1, a stand-in where no encoder is at hand."""
    from simlattice.functions.text import tokens, unit

    words = docs.select(F.col(id_col).alias("agent_id"), F.explode(tokens(text)).alias("w"))
    cell = (F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("long") % width).cast("int")
    n = words.groupBy("agent_id", cell.alias("k")).agg(F.count("*").cast("double").alias("x"))
    whole = n.groupBy("agent_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"))
    return whole.select("agent_id", unit(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))).alias("v"))
