"""Preference formatting of chat data (operator 3).

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role
and text) is rendered once, as the prompt; what follows on each side is its completion, with the
spans on which to train: the assistant's words in it. One shuffle brings a pair's turns together;
everything else is built-in expressions on its two arrays.

Tables of single conversations have no rejected sides. ``contrasted`` makes one for each: the same
turns, with the last answer of the assistant replaced by that of another conversation. Others come
from a bucket of about ``BUCKET`` conversations by hash, the next different answer in the order of
hashes there, so that neither a frequent answer nor a frequent conversation is a hot group.

Defined results: null roles and texts count as empty; turns are in order of turn, role and text, a
null turn first; repeated turns are kept; a pair with one side only has no prompt in common and is
not usable, as is one whose completions do not both hold words of the assistant; conversations
without an answer, or with no other answer in their bucket, are not usable; rows with a null pair or
conversation are left out; other columns are not read; an empty table gives no rows. A conversation
is one record and must fit in memory as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the marks of the chat template
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: conversations that may lend each other answers
BUCKET = 256


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def spans(turns: Column) -> Column:
    """start:end of the assistant's words, with the closing mark, in rendered(turns); comma-joined, in code points, ends exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.length(_head(t))
        b = a + F.length(t["text"]) + len(CLOSE) - 1
        said = F.when(t["role"] == LEARNED, F.concat(acc["found"], F.array(F.concat_ws(":", a.cast("string"), b.cast("string"))))).otherwise(acc["found"])
        return F.struct((b + 1).alias("at"), said.alias("found"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["found"]), ",")


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")


def formatted(turns: DataFrame) -> DataFrame:
    """A row for each pair. ``turns``: pair, chosen (boolean), turn, role, text."""
    own = turns.where(F.col("pair").isNotNull()).select("pair", "chosen", _turn())
    side = lambda ok: F.array_sort(F.collect_list(F.when(F.col("chosen") == ok, F.col("t"))))
    return completed(own.groupBy("pair").agg(side(True).alias("c"), side(False).alias("r")))


def completed(pairs: DataFrame) -> DataFrame:
    """Prompts and masked completions. ``pairs``: the turns of both sides as c and r, and other columns, which stay."""
    own = [F.col(x) for x in pairs.columns if x not in ("c", "r")]
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])), False)
    pairs = pairs.withColumn("n", F.when(differs == 0, F.size("c")).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    pairs = pairs.select(*own, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    learned = lambda c: F.exists(c, lambda t: (t["role"] == LEARNED) & (t["text"] != ""))
    return pairs.select(
        *own,
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        spans(F.col("c")).alias("chosen_spans"),
        rendered(F.col("r")).alias("rejected"),
        spans(F.col("r")).alias("rejected_spans"),
        (learned("c") & learned("r")).alias("usable"),
    )


def contrasted(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """conv_id, other_id, c, r: each conversation and itself with the last answer of another, and whose that is (-1 where none is lent)."""
    own = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", _turn()).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("c"))
    n = conversations.agg(F.count_distinct("conv_id").alias("n")).first()["n"]
    before = F.array_position(F.reverse(F.transform("c", lambda t: t["role"] == LEARNED)), True)
    own = own.withColumn("last", F.when(before > 0, F.size("c") - before + 1).otherwise(0).cast("int"))
    own = own.withColumn("answer", F.when(F.col("last") > 0, F.try_element_at("c", F.col("last"))["text"]))
    part = F.pmod(F.conv(F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(max(1, n // bucket)))
    own = own.withColumns({"part": part, "digest": F.md5("answer"), "mute": F.col("answer").isNull()})
    here = Window.partitionBy("part", "mute")
    own = own.withColumn("k", F.dense_rank().over(here.orderBy("digest")))
    lent = F.struct("conv_id", "answer")
    following = F.min(lent).over(here.orderBy("k").rangeBetween(1, 1))
    first = F.min(F.when(F.col("k") == 1, lent)).over(here)
    own = own.withColumn("other", F.when(F.col("answer").isNotNull(), F.coalesce(following, F.when(F.col("k") > 1, first))))
    upto = F.slice("c", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    after = F.slice("c", F.col("last") + 1, F.size("c"))
    changed = F.transform(F.slice("c", F.greatest("last", F.lit(1)), F.lit(1)), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("other.answer").alias("text")))
    r = F.when(F.col("last") == 0, F.col("c")).when(F.col("other").isNull(), upto).otherwise(F.concat(upto, changed, after))
    return own.select("conv_id", F.coalesce(F.col("other.conv_id"), F.lit(-1)).cast("long").alias("other_id"), "c", r.alias("r"))


def report(conversations: DataFrame) -> DataFrame:
    """All conversations as chosen sides, each against itself with another's last answer."""
    return completed(contrasted(conversations))


#: DuckDB SQL for report()
SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(k) FILTER (role = '{LEARNED}') AS last, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::UBIGINT % greatest(1, (SELECT count(DISTINCT conv_id) FROM o) // {BUCKET})::UBIGINT AS part
      FROM o GROUP BY 1),
a AS (SELECT conv_id, part, text AS answer, dense_rank() OVER (PARTITION BY part ORDER BY md5(text)) AS d FROM o JOIN l USING (conv_id) WHERE k = last),
g AS (SELECT part, d, min(conv_id) AS other_id, any_value(answer) AS lent, max(d) OVER (PARTITION BY part) AS most FROM a GROUP BY part, d),
b AS (SELECT a.conv_id, h.other_id, h.lent FROM a JOIN g USING (part, d) LEFT JOIN g h ON h.part = a.part AND h.d = CASE WHEN a.d < g.most THEN a.d + 1 ELSE 1 END AND h.d <> a.d),
t AS (SELECT conv_id, 0 AS side, role, text, k FROM o UNION ALL
      SELECT conv_id, 1, role, CASE WHEN k = last THEN lent ELSE text END, k FROM o JOIN l USING (conv_id) LEFT JOIN b USING (conv_id)
      WHERE last IS NULL OR k < last OR other_id IS NOT NULL),
m AS (SELECT conv_id, k, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS same FROM t GROUP BY ALL),
n AS (SELECT conv_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM m GROUP BY ALL),
x AS (SELECT t.*, n.n, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) AS said,
             sum(CASE WHEN k > n THEN {len(OPEN) + 1 + len(CLOSE)} + length(role) + length(text) END) OVER (PARTITION BY conv_id, side ORDER BY k) AS until
      FROM t JOIN n USING (conv_id)),
s AS (SELECT *, CASE WHEN k > n AND role = '{LEARNED}' THEN (until - 1 - {len(CLOSE) - 1} - length(text))::BIGINT::VARCHAR || ':' || (until - 1)::BIGINT::VARCHAR END AS span FROM x)
SELECT s.conv_id, coalesce(any_value(b.other_id), -1)::BIGINT AS other_id, n::BIGINT AS n_prompt_turns,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (k <= n AND side = 0), '') AS prompt,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (k > n AND side = 0), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (span IS NOT NULL AND side = 0), '') AS chosen_spans,
       coalesce(string_agg(said, '' ORDER BY k) FILTER (k > n AND side = 1), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (span IS NOT NULL AND side = 1), '') AS rejected_spans,
       count(*) FILTER (k > n AND role = '{LEARNED}' AND text <> '' AND side = 0) > 0 AND count(*) FILTER (k > n AND role = '{LEARNED}' AND text <> '' AND side = 1) > 0 AS usable
FROM s LEFT JOIN b USING (conv_id) GROUP BY s.conv_id, n
"""
