"""Fill-in-the-middle: a text's middle goes behind its suffix, between sentinels that tell how to put it back.

DataFrame functions only, one pass, no shuffle. The units are code points.
``regexp_extract_all`` makes an array of runs of ``RUN`` units, and the array of
single units of the two runs that a cut falls into; ``slice`` and ``array_join``
put arrangements together from both. So a text takes memory for its bytes and a
few thousand units, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.session import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
#: Units of a run; changes no result.
RUN = 256
#: Percent of texts that are transformed, and percent of these with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of eight hex digits of the sha256 of ``seed:id``; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _units(runs: Column, at: Column) -> Column:
    """The single units of the run that place ``at`` is in; none behind the end."""
    return F.regexp_extract_all(F.coalesce(F.try_element_at(runs, _run(at) + 1), F.lit("")), F.lit("(?s)."), F.lit(0))


def _run(at: Column) -> Column:
    return F.floor(at / RUN).cast("int")


def _place(at: Column) -> Column:
    return (at % RUN).cast("int")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; null if its sentinels aren't those of the form."""
    parts = F.split(output, SENTINEL, -1)
    marks = F.array_join(F.regexp_extract_all(output, F.lit(SENTINEL), F.lit(0)), "")
    part = lambda k: F.element_at(parts, k)
    return (
        F.when(form == "plain", output)
        .when((form == "psm") & (marks == PREFIX + SUFFIX + MIDDLE), F.concat(part(2), part(4), part(3)))
        .when((form == "spm") & (marks == SUFFIX + PREFIX + MIDDLE), F.concat(part(3), part(4), part(2)))
    )


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """One row per document: id, n (code points), form, prefix_chars, middle_chars and output.

    ``form`` is psm (prefix, suffix, middle), spm (suffix first) or plain. Empty
    and null texts, texts that hold a sentinel and those that the draws of the id
    leave out (100 - ``rate`` percent) are plain: the output is the text, the
    counts are null. Rows with one id have the same draws, each over its own text;
    null ids draw alike. Other columns are not carried, whatever their names. Empty
    in, empty out.
    """
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text").cast("long")
    plain = (n == 0) | F.col("text").rlike(SENTINEL) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    chosen = texts.select("id", "text", n.alias("n"), form.alias("form"), (h1 % (n + 1)).alias("a"), (h2 % (n + 1)).alias("b"))
    cut = F.when(F.col("form") != "plain", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0)))
    low, high, runs, one, two = F.least("a", "b"), F.greatest("a", "b"), F.col("runs"), F.col("units_a"), F.col("units_b")
    cuts = chosen.select("id", "text", "n", "form", low.alias("a"), high.alias("b"), cut.alias("runs"))
    cuts = cuts.select("*", _units(runs, F.col("a")).alias("units_a"), _units(runs, F.col("b")).alias("units_b"))
    a, b = F.col("a"), F.col("b")
    prefix = F.concat(F.slice(runs, F.lit(1), _run(a)), F.slice(one, F.lit(1), _place(a)))
    middle = F.when(_run(a) == _run(b), F.slice(one, _place(a) + 1, (b - a).cast("int"))).otherwise(
        F.concat(F.slice(one, _place(a) + 1, F.lit(RUN)), F.slice(runs, _run(a) + 2, F.greatest(_run(b) - _run(a) - 1, F.lit(0))), F.slice(two, F.lit(1), _place(b)))
    )
    suffix = F.concat(F.slice(two, _place(b) + 1, F.lit(RUN)), F.slice(runs, _run(b) + 2, F.size(runs) + 1))
    part = lambda units: F.array_join(units, "")
    pieces = {
        "psm": [F.lit(PREFIX), part(prefix), F.lit(SUFFIX), part(suffix), F.lit(MIDDLE), part(middle)],
        "spm": [F.lit(SUFFIX), part(suffix), F.lit(PREFIX), part(prefix), F.lit(MIDDLE), part(middle)],
    }
    built = F.when(F.col("form") == "plain", F.col("text"))
    for name, arrangement in pieces.items():
        built = built.when(F.col("form") == name, F.concat(*arrangement))
    counts = [F.when(F.col("form") != "plain", c).alias(name) for c, name in ((a, "prefix_chars"), (b - a, "middle_chars"))]
    return cuts.select(F.col("id").alias(id_col), "n", "form", *counts, built.alias("output"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and counts, the digest of its output and of the text restored from that."""
    made = fill_middle(table(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLES = {
    "op13_fill_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, x, CAST(length(x) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
             CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(x, 1, a) AS pre, substring(x, a + 1, b - a) AS mid, substring(x, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p"""
}
QUERIES = {"op13_fill_middle": op13_fill_middle}
