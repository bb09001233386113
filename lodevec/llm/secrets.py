"""Secret scans: plain base rules, and character Markov models that tell random strings from ordinary identifiers.

Two first-order chains over the characters of candidate strings are trained from labelled samples: random strings
(label 1: strings drawn from hashes in common alphabets, and the values that the base rules find) and identifiers
(label 0: words of a bounded sample of texts, alone and joined the ways code joins them, and numbers). Every run of
characters of at least 12 is a candidate, and its log-likelihood ratio alone decides: it must reach a least value for
each character and a least value in all, which short strings reach only if they look the more random.

DataFrame and SQL functions only; what reaches the driver is the table of character pairs, of fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import hashed_sample
from lodevec.llm.matches import spans_sql, sql_text

#: The kinds in their order and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: 18+ characters and 16+ characters: a run is matched whole, so its length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."


@dataclass(frozen=True)
class SecretParams:
    """assign_chars: least length of an assigned value; random: random strings drawn for each alphabet; sample_docs:
    documents that identifiers are taken from (those with the smallest hashed ids); smooth: pseudo-count of a pair of
    characters; least, least_sum: least log-likelihood ratio per character and of the whole string."""

    assign_chars: int = 12
    random: int = 2_000
    sample_docs: int = 2_000
    smooth: float = 0.5
    least: float = 0.8
    least_sum: float = 16.0


def base_spans(text: str, p: SecretParams) -> str:
    """SQL for the base rules' spans of a text column."""
    return "concat(" + ", ".join([spans_sql(text, ASSIGN, 0, f"length(x.part) >= {p.assign_chars}", 2), spans_sql(text, ACCESS, 1), spans_sql(text, HEX, 2)]) + ")"


def labelled_samples(docs: DataFrame, p: SecretParams) -> DataFrame:
    """(sample, label): the training strings. Base values come from all documents."""
    spark: SparkSession = docs.sparkSession
    seeds = spark.range(p.random).select("id", F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256).alias("h"))
    forms = ["substring(h, 1, 40)", "upper(substring(h, 1, 32))", "replace(base64(unhex(substring(h, 1, 60))), '=', '')", "replace(replace(base64(unhex(substring(h, 5, 60))), '+', '-'), '/', '_')",
             "conv(substring(h, 1, 15), 16, 36) || lower(conv(substring(h, 16, 15), 16, 36))", "lower(conv(substring(h, 31, 15), 16, 36) || conv(substring(h, 46, 15), 16, 36))"]
    drawn = seeds.select(F.explode(F.array(*map(F.expr, forms))).alias("sample"))
    found = docs.select(F.coalesce("text", F.lit("")).alias("_text")).select(F.explode(F.expr(base_spans("_text", p))).alias("b")).select(F.col("b.v").alias("sample"))
    # Ids are chosen without their texts; only the chosen ones' texts move, one for each id.
    ids = hashed_sample(docs.where("doc_id is not null").select(F.col("doc_id").alias("_id")), "_id", p.sample_docs).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).where("text is not null").groupBy("_id").agg(F.min("text").alias("text")).select("text")
    plain = texts.select(F.expr(f"filter(regexp_extract_all(text, '[A-Za-z]+', 0), w -> length(w) >= 2 and not w rlike {sql_text(HEX)})").alias("w"))
    # A name of three neighbouring words, in the styles of code and of paths.
    triples = plain.where("size(w) >= 3").select(F.explode(F.expr("transform(sequence(1, cast(floor(size(w) / 3) as int)), i -> slice(w, 3 * i - 2, 3))")).alias("t"))
    styles = ["array_join(t, '_')", "array_join(t, '-')", "array_join(t, '/')", "upper(array_join(t, '_'))", "lower(array_join(t, ''))", "replace(initcap(array_join(t, ' ')), ' ', '')", "array_join(t, '.')"]
    names = triples.select(F.expr(f"element_at(array({', '.join(styles)}), cast(pmod(xxhash64(t), {len(styles)}) as int) + 1)").alias("sample"))
    # Numbers are ordinary: accounts, times and identifiers of 12 to 19 digits.
    numbers = seeds.select(F.expr("substring(conv(substring(h, 20, 15), 16, 10) || conv(substring(h, 40, 15), 16, 10), 1, 12 + cast(pmod(id, 8) as int))").alias("sample"))
    return drawn.union(found).withColumn("label", F.lit(1)).union(names.union(numbers).withColumn("label", F.lit(0)))


def fit(samples: DataFrame, p: SecretParams) -> list[float]:
    """log(P_random(next | last) / P_identifier(next | last)) for each pair of characters, row by row; place 0 stands
    for any other character and for the start."""
    n = len(ALPHABET) + 1
    codes = samples.select("label", F.expr(f"concat(array(0), transform(filter(split(sample, ''), c -> c <> ''), c -> instr({sql_text(ALPHABET)}, c)))").alias("c"))
    pairs = codes.select("label", F.explode(F.expr(f"if(size(c) > 1, transform(sequence(1, size(c) - 1), i -> c[i - 1] * {n} + c[i]), cast(array() as array<int>))")).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for last in range(n):
        sums = [sum(counts.get((label, last * n + k), 0) for k in range(n)) + p.smooth * n for label in (0, 1)]
        out += [math.log((counts.get((1, last * n + k), 0) + p.smooth) / sums[1]) - math.log((counts.get((0, last * n + k), 0) + p.smooth) / sums[0]) for k in range(n)]
    return out


def scan(docs: DataFrame, params: SecretParams = SecretParams(), samples: DataFrame | None = None) -> DataFrame:
    """(doc_id, _base, _spans) of docs (doc_id, text): arrays of structs (s, k, e, v) by start, then kind.

    Null text counts as empty and has no spans. Rows are scanned one by one; repeated rows and null keys stay. A string
    that the Markov models report is dropped if a base span holds all of it. samples: (sample, label) to train from in
    place of labelled_samples(); with an empty table the models know nothing of the texts but the drawn strings.
    """
    p = params
    n = len(ALPHABET) + 1
    ratios = ",".join(f"{x:.4f}" for x in fit(labelled_samples(docs, p) if samples is None else samples, p))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_base", F.expr(f"array_sort({base_spans('_text', p)})"))
    rows = rows.withColumn("_may", F.expr(spans_sql("_text", CANDIDATE, 3)))
    rows = rows.withColumn("_may", F.expr("filter(_may, m -> not exists(_base, b -> b.s <= m.s and m.e <= b.e))"))
    code = f"concat(array(0), transform(filter(split(m.v, ''), c -> c <> ''), c -> instr({sql_text(ALPHABET)}, c)))"
    ratio = f"cast(split('{ratios}', ',') as array<double>)"
    llr = f"element_at(transform(array({code}), c -> aggregate(sequence(1, size(c) - 1), 0D, (a, i) -> a + element_at({ratio}, c[i - 1] * {n} + c[i] + 1))), 1)"
    rows = rows.withColumn("_spans", F.expr(f"array_sort(concat(_base, filter(_may, m -> {llr} >= greatest({p.least_sum}, {p.least} * (m.e - m.s)))))"))
    return rows.drop("_text", "_may")


def spans_text(column: str) -> str:
    """SQL for kind:start:end of the spans, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, b -> concat_ws(':', element_at(array({kinds}), b.k + 1), cast(b.s as string), cast(b.e as string))), ',')"


def secrets(docs: DataFrame, params: SecretParams = SecretParams(), samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (doc_id, text)."""
    found = scan(docs, params, samples)
    counts = [F.expr(f"cast(size(filter(_base, b -> b.k = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(F.expr(spans_text("_base")), 256).alias("base_sha256"), F.expr(spans_text("_spans")).alias("spans"))
