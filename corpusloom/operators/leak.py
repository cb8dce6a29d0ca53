"""Leak scans: probes of a held-out set, looked for in a corpus, and the clean rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from corpusloom.functions import grams
from corpusloom.functions import text as T
from corpusloom.sources.storage import materialize

PROBE_CHARS, PER_LINE, LEAST_BYTES, SEED = 48, 3, 96, 20
#: Seeds that are broadcast: 16 bytes each, and the patterns.
MOST_SEEDS = 1 << 21


def probes(lines: DataFrame, chars: int = PROBE_CHARS, per_line: int = PER_LINE, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """line_no, probe: parts at even places (half-even rounding) of each line (line_no, text),
    each grown to the right until it has least_bytes, or dropped. Equal probes keep the first
    line. Markers are taken out first, white space is collapsed."""
    t = lines.select("line_no", T.collapse(T.without_markers(F.coalesce("text", F.lit("")))).alias("t")).where(F.length("t") >= chars)
    usable = F.length("t") - chars
    place = F.lit(0) if per_line == 1 else F.bround(usable * F.col("i") / F.lit(per_line - 1), 0).cast("int")
    at = t.select("line_no", "t", F.explode(F.sequence(F.lit(0), F.lit(per_line - 1))).alias("i")).select("line_no", "t", place.alias("s"))
    rest = at.select("line_no", F.substring(F.col("t"), F.col("s") + 1, F.lit(max(chars, least_bytes))).alias("rest"))
    # the least length from chars on whose prefix has the bytes; one byte a character at least
    lengths = F.sequence(F.lit(chars), F.greatest(F.lit(chars), F.length("rest")))
    fits = F.filter(lengths, lambda n: F.octet_length(F.substring(F.col("rest"), F.lit(1), n)) >= least_bytes)
    grown = rest.select("line_no", F.substring(F.col("rest"), F.lit(1), F.get(fits, F.lit(0))).alias("probe")).where("probe is not null")
    return grown.groupBy("probe").agg(F.min("line_no").alias("line_no"))


def shippable(rows: DataFrame, column: str, seeds_each: int, most_seeds: int) -> list[str] | None:
    """The texts of a column, if their seeds are no more than most_seeds and their characters no
    more than 16 for each seed allowed: what may be broadcast. Else None."""
    size = rows.agg(F.sum(F.least(F.length(column), F.lit(seeds_each))).alias("seeds"), F.sum(F.length(column)).alias("chars")).first()
    if (size.seeds or 0) > most_seeds or (size.chars or 0) > 16 * most_seeds:
        return None
    return rows.select(column).toArrow().column(0).to_pylist()


def occurrences(corpus: DataFrame, wanted: DataFrame, shortest: int = PROBE_CHARS, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """probe, doc_id, start for every place (from 0) of a wanted probe in the corpus (doc_id,
    text). Any occurrence holds a seed that begins at a multiple of shortest - SEED + 1, and is
    met by just one of the probe's first seeds. Probes whose seeds are no more than most_seeds
    go to the workers as sorted hashes, and a text is scanned and verified where it is read; more
    are joined by their seeds."""
    stride = shortest - SEED + 1
    wanted = wanted.where(F.length("probe") >= shortest).select("probe").distinct()
    probes_here = shippable(wanted, "probe", stride, most_seeds)
    return joined_occurrences(corpus, wanted, stride) if probes_here is None else scanned_occurrences(corpus, probes_here, stride)


def scanned_occurrences(corpus: DataFrame, patterns: list[str], stride: int) -> DataFrame:
    shipped = corpus.sparkSession.sparkContext.broadcast(patterns)  # of the size that shippable() allows
    schema = T_.StructType([T_.StructField("probe", T_.StringType()), corpus.schema["doc_id"], T_.StructField("start", T_.IntegerType())])

    def run(batches):
        import pyarrow as pa

        seeds = grams.Seeds(shipped.value, SEED, stride)
        for batch in batches:
            found = []
            for at, part in grams.portions(batch.column(1).to_pylist()):
                for k, place, p, offset in seeds.meetings(part, stride):
                    if place >= offset and part[k].startswith(seeds.patterns[p], place - offset):
                        found.append((seeds.patterns[p], at + k, place - offset))
            rows = pa.array([x[1] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), batch.column(0).take(rows), pa.array([x[2] for x in found], pa.int32())], ["probe", "doc_id", "start"])

    return corpus.select("doc_id", "text").mapInArrow(run, schema)


def joined_occurrences(corpus: DataFrame, wanted: DataFrame, stride: int) -> DataFrame:
    mine = corpus.where(F.length("text") >= stride + SEED - 1).select("doc_id", F.posexplode(T.strided_windows(F.col("text"), SEED, stride)).alias("n", "gram")).select("doc_id", (F.col("n") * stride).alias("p"), "gram")
    theirs = wanted.select("probe", F.posexplode(F.slice(T.windows(F.col("probe"), SEED), F.lit(1), F.lit(stride))).alias("at", "gram"))
    # more than MOST_SEEDS rows, which the planner takes to be as few as the probes
    met = mine.join(theirs.hint("merge"), "gram").select("doc_id", "probe", (F.col("p") - F.col("at")).alias("start")).where("start >= 0").distinct()
    whole = met.join(corpus.select("doc_id", "text"), "doc_id")
    return whole.where(F.substring(F.col("text"), F.col("start") + 1, F.length("probe")) == F.col("probe")).select("probe", "doc_id", "start")


def report(corpus: DataFrame, lines: DataFrame, examples: int = 5) -> DataFrame:
    """One row: probes, hit_probes, occurrences, leaked, affected_lines and the examples with
    the most occurrences. Probes and hits are stored, so that the corpus is scanned once."""
    wanted = materialize(probes(lines), "leak-probes")
    hits = materialize(occurrences(corpus, wanted).groupBy("probe").agg(F.count("*").alias("n")).join(wanted, "probe"), "leak-hits")
    found = hits.agg(
        F.count("*").alias("hit_probes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"),
        F.array_sort(F.collect_set("line_no")).alias("affected_lines"),
        F.coalesce(F.max(F.col("n") > 0), F.lit(False)).alias("leaked"),
    )
    top = hits.orderBy(F.desc("n"), "probe").limit(examples).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "probe", "n"))).alias("e")).select(F.transform("e", lambda x: F.struct(x["probe"].alias("probe"), x["n"].alias("n"))).alias("examples"))
    return wanted.agg(F.count("*").alias("probes")).crossJoin(found).crossJoin(top)


def clean_lines(lines: DataFrame, leak: DataFrame) -> DataFrame:
    """The lines that a report does not name."""
    return lines.join(leak.select(F.explode("affected_lines").alias("line_no")), "line_no", "left_anti")
