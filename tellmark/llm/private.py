"""Personal data: fixed patterns, and contexts learned from them that point out identifiers no pattern knows.

Everything is DataFrame expressions. The fixed patterns give base spans, which
are the seeds. A seed has two contexts: the two words before it, and the words
before and after it, in lower case and with every digit as 0. Contexts of several
seeds are patterns. Patterns and what stands in them form a bipartite graph: a
pattern's confidence is the score of what stands in it over how often it occurs in
the corpus at all, an instance's score is the chance that one of its patterns is
right, seeds stay certain. After a few rounds, identifier-like words that
confident patterns point at become instances of the pattern's kind. Instances
join the seeds, and patterns are made anew, until no new one comes.

A context is a pattern only if something identifier-like stands in it, and if it
could reach the confidence should all of that be right. Others are everyday words
around an identifier; they take no part in the graph, so they lend no score either.

Places of matches are sums over matches and the gaps between them, taken in chunks,
and contexts come from pieces of ``REACH`` code points that the same scan carries:
the time of a text follows its length, however many matches it has.

A text is scanned once for spans and candidates, and once more to count the
contexts that became patterns; texts are never shuffled. Common contexts are
found out in the few texts with an at sign, so that the count over all texts
meets only contexts that are about as rare as the identifiers behind them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.common import cut, stored
from tellmark.session import table

KINDS = ("email", "ip", "card", "phone")
#: As asked for, but possessive and entered only where a match can start: runs of any length take linear time.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A word with a digit or an at sign.
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[0-9@][^\x20\x09-\x0D]*+"
#: Numbers of several words, and names and hosts around a bracketed at.
_SPACED = r"(?<![^\x20\x09-\x0D])[(+]{0,2}+[0-9][0-9().,:/_\[\]-]*+(?:\x20[(\[]?+[0-9][0-9().,:/_\[\]-]*+)++(?![^\x20\x09-\x0D])"
_AT = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++\x20?+[(\[{<]\x20?+(?i:at)\x20?+[)\]}>]\x20?+[\p{L}0-9][\p{L}0-9.-]*+"
_FOUR = r"^[^\p{L}\p{N}]*+[0-9]{1,3}(?:[^\p{L}\p{N}]{1,3}[0-9]{1,3}){3}[^\p{L}\p{N}]*+$"
#: The two words before the word that ends here or begins here, and the word after it.
_CONTEXT = r"([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[^\x20\x09-\x0D]*+$"
_AFTER = r"^[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
_SPANS = "array<struct<kind: int, start: int, end: int, value: string, contexts: array<bigint>>>"
#: Different seeds, in different documents, that make a context a pattern.
SUPPORT = 3
CONFIDENCE = 0.5
ROUNDS = 3
#: Marks that tell a text's contexts from those that are no patterns; false hits are sorted out by a join.
SLOTS = 1 << 17
#: Code points before a span in which its context is looked for first; one that isn't whole there is taken from the whole text.
REACH = 100


#: Items that a scan takes at once: arrays grow by as many, so that time follows their length.
CHUNK = 256
_SPAN = "struct<start: int, end: int, value: string, lead: string, soon: string>"


def _scan(items: str, state: str, zero: str, step: str) -> Column:
    """The states of a fold after each item, in SQL. ``items`` is a column, ``step`` makes a state of the state ``p`` before and the item ``x``."""
    after = re.sub(r"\bp\.", "element_at(a, -1).", step)
    last = f"coalesce(element_at(get(done, size(done) - 1), -1), CAST({zero} AS {state}))"
    grown = f"aggregate(slice({items}, k * {CHUNK} + 1, {CHUNK}), array({last}), (a, x) -> concat(a, array(CAST({after} AS {state}))))"
    chunks = f"aggregate(sequence(0, CAST(ceil(size({items}) / {CHUNK}) AS INT) - 1), CAST(array() AS array<array<{state}>>), (done, k) -> concat(done, array(slice({grown}, 2, {CHUNK}))))"
    return F.expr(f"CASE WHEN size({items}) > 0 THEN flatten({chunks}) ELSE CAST(array() AS array<{state}>) END")


def with_matches(texts: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds a column of matches for every name: start, end (code points, from 0), value, and the text around, REACH code points each.

    ``patterns`` has a pattern and a test for each name; texts that fail the test
    have no matches. One scan forward and one back over matches and the gaps between them.
    """
    none, places = "CAST(array() AS array<string>)", range(len(patterns))
    df = texts.withColumns({f"_hits{k}": F.when(worth, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.expr(none)) for k, (p, worth) in enumerate(patterns.values())})
    df = df.withColumns({f"_gaps{k}": F.when(F.size(f"_hits{k}") > 0, F.split("text", p, -1)).otherwise(F.expr(none)) for k, (p, _) in enumerate(patterns.values())})
    pairs = lambda k, at: f"zip_with(slice(_gaps{k}, {at}, size(_hits{k})), _hits{k}, (g, m) -> named_struct('g', g, 'm', m))"
    df = df.withColumns({f"_steps{k}": F.expr(pairs(k, 1)) for k in places} | {f"_back{k}": F.expr(f"reverse({pairs(k, 2)})") for k in places})
    forward = (
        "struct<start: int, end: int, lead: string, tail: string>", "named_struct('start', 0, 'end', 0, 'lead', '', 'tail', '')",
        f"named_struct('start', p.end + length(x.g), 'end', p.end + length(x.g) + length(x.m), 'lead', right(concat(p.tail, x.g), {REACH}), 'tail', right(concat(p.tail, x.g, x.m), {REACH}))",
    )
    # of a match: what follows it; the match that follows stands in the state
    behind = ("struct<soon: string, m: string>", "named_struct('soon', '', 'm', '')", f"named_struct('soon', left(concat(left(x.g, {REACH}), left(p.m, {REACH}), p.soon), {REACH}), 'm', x.m)")
    df = df.withColumns({f"_forward{k}": _scan(f"_steps{k}", *forward) for k in places} | {f"_behind{k}": F.reverse(_scan(f"_back{k}", *behind)) for k in places})
    span = "(f, b) -> named_struct('start', f.start, 'end', f.end, 'value', b.m, 'lead', f.lead, 'soon', b.soon)"
    return df.select(*texts.columns, *(F.expr(f"zip_with(_forward{k}, _behind{k}, {span})").alias(name) for k, name in enumerate(patterns)))


def without_overlaps(df: DataFrame, name: str, base: str, kind: str) -> DataFrame:
    """``name`` (an array of ``kind``) without what overlaps a span of ``base``, in order of starts. Spans are not empty.

    Both arrays are sorted together; a scan forward tells how far spans of base
    reached, one back where the next begins.
    """
    mark = f"struct<start: int, of: int, end: int, one: {kind}>"
    of_base = f"CAST(transform({base}, b -> named_struct('start', b.start, 'of', 0, 'end', b.end, 'one', CAST(NULL AS {kind}))) AS array<{mark}>)"
    of_name = f"CAST(transform({name}, c -> named_struct('start', c.start, 'of', 1, 'end', c.end, 'one', c)) AS array<{mark}>)"
    both = f"size({base}) > 0 AND size({name}) > 0"
    order = "(a, b) -> CASE WHEN a.start <> b.start THEN CAST(signum(a.start - b.start) AS INT) ELSE a.of - b.of END"
    df = df.withColumn("_marks", F.expr(f"CASE WHEN {both} THEN array_sort(concat({of_base}, {of_name}), {order}) ELSE CAST(array() AS array<{mark}>) END"))
    df = df.withColumn("_turned", F.reverse("_marks"))
    state = "struct<at: int, free: boolean>"
    reached = _scan("_marks", state, "named_struct('at', -1, 'free', true)", "named_struct('at', IF(x.of = 0, greatest(p.at, x.end), p.at), 'free', p.at <= x.start)")
    next_ = _scan("_turned", state, "named_struct('at', 2147483647, 'free', true)", "named_struct('at', IF(x.of = 0, x.start, p.at), 'free', p.at >= x.end)")
    df = df.withColumns({"_reached": reached, "_next": F.reverse(next_)})
    free = "zip_with(_marks, zip_with(_reached, _next, (r, n) -> r.free AND n.free), (m, ok) -> IF(ok AND m.of = 1, m.one, NULL))"
    kept = F.expr(f"CASE WHEN {both} THEN filter({free}, c -> c IS NOT NULL) ELSE {name} END")
    return df.withColumn(name, kept).drop("_marks", "_turned", "_reached", "_next")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_ip(value: Column) -> Column:
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    number = lambda part: F.coalesce(F.expr("try_cast(0 AS int)") + F.when(small(part), part.cast("int")), F.lit(999))
    return F.forall(F.split(value, r"\."), lambda part: number(part) <= 255)


def _plain(word: Column) -> Column:
    """A context's word: lower case, every digit a 0."""
    return F.regexp_replace(F.lower(word), "[0-9]", "0")


def _two_before(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _around(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit("around"), a, b)


def with_contexts(df: DataFrame, *names: str) -> DataFrame:
    """Columns of spans with ``contexts``, hashes of their contexts: the two words before the word it starts in, and the words around it; those there are."""
    text = F.col("text")

    def before(part: Column, lead: str, k: int) -> Column:
        return _plain(F.regexp_extract(part, lead + _CONTEXT, k))

    # what isn't whole in reach is taken from the whole text
    def words(s: Column) -> Column:
        near = F.array(before(s["lead"], r"[\x20\x09-\x0D]", 1), before(s["lead"], r"[\x20\x09-\x0D]", 2))
        whole = F.when(s["start"] <= REACH, s["lead"]).otherwise(F.substring(text, F.lit(1), s["start"]))
        far = F.array(before(whole, r"(?:^|[\x20\x09-\x0D])", 1), before(whole, r"(?:^|[\x20\x09-\x0D])", 2))
        return F.when(s["lead"].rlike(r"[\x20\x09-\x0D]" + _CONTEXT), near).otherwise(far)

    def after(s: Column) -> Column:
        rest = F.when(F.length(s["soon"]) < REACH, s["soon"]).otherwise(F.substring(text, s["end"] + 1, F.length(text)))
        near = s["soon"].rlike(_AFTER + r"[\x20\x09-\x0D]")
        return _plain(F.when(near, F.regexp_extract(s["soon"], _AFTER, 1)).otherwise(F.regexp_extract(rest, _AFTER, 1)))

    df = df.withColumns({f"_w_{name}": F.transform(name, lambda s: F.struct(words(s).alias("two"), after(s).alias("after"))) for name in names})

    def hashes(s: Column, w: Column) -> Column:
        a, b, c = w["two"][0], w["two"][1], w["after"]
        inside = ~F.contains(s["value"], F.lit(" "))
        both = F.array(F.when(b != "", _two_before(a, b)), F.when((b != "") & (c != "") & inside, _around(b, c)))
        return F.filter(both, lambda h: h.isNotNull())

    full = lambda s, w: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), hashes(s, w).alias("contexts"))
    return df.withColumns({name: F.zip_with(name, f"_w_{name}", full) for name in names}).drop(*(f"_w_{name}" for name in names))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


_KIND = f"struct<kind: int, {_SPAN[len('struct<'):]}"


def _of_kind(found: Column, kind: int, good) -> Column:
    one = lambda s: F.struct(F.lit(kind).alias("kind"), *(s[c].alias(c) for c in ("start", "end", "value", "lead", "soon")))
    return F.transform(F.filter(found, good), one)


def with_spans(texts: DataFrame) -> DataFrame:
    """Adds ``base``, all base spans by kind and start, and ``other``, candidates; both with values and contexts.

    Candidates are what is like an identifier, without marks around it, as spans of
    kind -1 that overlap no base span: words with six digits, an at sign or four
    short numbers, and runs of words: numbers with six digits in all, and names
    and hosts around a bracketed at.
    """
    text = F.col("text")
    many = lambda s: F.length(_digits(s["value"])) >= 6
    like = lambda s: F.contains(s["value"], F.lit("@")) | many(s) | s["value"].rlike(_FOUR)
    kinds = {
        "_email": (_EMAIL, F.contains(text, F.lit("@"))),
        "_ip": (_IP, text.rlike(r"[0-9]\.[0-9]")),
        "_card": (_CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){12}")),
        "_phone": (_PHONE, F.contains(text, F.lit("+"))),
    }
    shapes = {
        "_ats": (_AT, text.rlike(r"(?i)[(\[{<]\x20?at\x20?[)\]}>]")),
        "_spaced": (_SPACED, text.rlike(r"[0-9][().,:/_\[\]-]*\x20[(\[]?[0-9]")),
        "_other": (_CANDIDATE, text.rlike("@|[0-9][^\\x20\\x09-\\x0D]*[0-9]")),
    }
    sound = (lambda s: F.lit(True), lambda s: _is_ip(s["value"]), lambda s: _luhn(s["value"]), lambda s: _between(F.length(_digits(s["value"])), 9, 15))
    df = with_matches(texts, kinds | shapes)
    base = F.concat(*(_of_kind(F.col(n), k, good) for k, (n, good) in enumerate(zip(kinds, sound, strict=True))))
    df = df.select(*texts.columns, base.alias("base"), "_ats", F.filter("_spaced", many).alias("_spaced"), F.filter("_other", like).alias("_other"))
    df = without_overlaps(df, "_spaced", "_ats", _SPAN)
    df = df.withColumn("_runs", F.concat("_ats", "_spaced"))
    df = without_overlaps(df, "_other", "_runs", _SPAN)
    # contexts are of the whole words, ends are those of what stands between marks
    df = df.select(*texts.columns, "base", _of_kind(F.concat("_runs", "_other"), -1, lambda s: F.lit(True)).alias("other"))
    df = with_contexts(df, "base", "other")
    lead = lambda v: F.length(v) - F.length(F.regexp_replace(v, r"^[^\p{L}\p{N}+]+", ""))
    trail = lambda v: F.length(v) - F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]+$", ""))
    trimmed = F.transform(
        "other",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            (s["start"] + lead(s["value"])).alias("start"),
            (s["end"] - trail(s["value"])).alias("end"),
            F.regexp_replace(F.regexp_replace(s["value"], r"^[^\p{L}\p{N}+]+", ""), r"[^\p{L}\p{N}]+$", "").alias("value"),
            s["contexts"].alias("contexts"),
        ),
    )
    df = df.withColumn("other", trimmed).withColumn("other", F.filter("other", lambda s: (F.size(s["contexts"]) > 0) & (s["end"] > s["start"])))
    return without_overlaps(df, "other", "base", _SPANS[len("array<") : -1])


def context_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(context, total): how often each pattern occurs around a word, over all texts.

    A table of ``SLOTS`` marks, the same size for any number of patterns, drops
    nearly all other contexts of a text before they become rows.
    """
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    marks = bytearray(SLOTS)
    for (k,) in patterns.select(slot(F.col("context"))).distinct().collect():  # at most SLOTS numbers
        marks[k] = 1
    words = F.filter(F.split(_plain(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rest = F.greatest(F.size("w") - 2, F.lit(0))
    first, second, third = (F.slice("w", k, rest) for k in (1, 2, 3))
    found = F.concat(F.zip_with(first, second, _two_before), F.zip_with(first, third, _around))
    marked = F.filter(found, lambda h: F.substring(F.lit(bytes(marks)), slot(h) + 1, F.lit(1)) == F.lit(b"\x01"))
    contexts = texts.select(words.alias("w")).select(F.explode(marked).alias("context"))
    return contexts.join(patterns.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.count("*").alias("total"))


def reachable(edges: DataFrame, totals: DataFrame, confidence: float) -> DataFrame:
    """(kind, context) of the patterns that reach the confidence if all that follows them is right; no total counts as 0."""
    most = edges.groupBy("kind", "context").agg(F.sum("n").alias("most"))
    total = F.coalesce("total", F.lit(0)) + 1
    return most.join(totals, "context", "left").where(F.col("most") >= confidence * total).select("kind", "context")


def score(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns (kind, context) and scores of instances (kind, value) after some rounds.

    ``edges`` has kind, context, value, n (occurrences) and seed (the value is a
    base span of that kind). Both tables are small: contexts with support only.
    """
    seeds = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    scores = seeds.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score"))
    confidence = None
    for _ in range(rounds):
        weighed = edges.join(scores, ["kind", "value"])
        confidence = (
            weighed.groupBy("kind", "context").agg(F.sum(F.col("n") * F.col("score")).alias("mass")).join(totals, "context")
            .select("kind", "context", F.least(F.col("mass") / (F.col("total") + 1), F.lit(0.99)).alias("confidence"))
        )
        confidence = cut(confidence)
        held = edges.join(confidence, ["kind", "context"]).groupBy("kind", "value").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("chance")
        )
        scores = cut(held.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(F.col("chance")).alias("score")))
    return confidence, scores


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: id, base and added, arrays of (kind, start, end) by kind and start.

    ``kind`` is a place in ``KINDS``; places are code points from 0, the end is
    exclusive. ``added`` spans follow a learned pattern and overlap no base span.
    A null text is empty. Rows are scanned each on its own, so repeated rows and
    ids give equal rows; other columns are not carried. Empty in, empty out.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    seen = stored(with_spans(texts.withColumn("h", F.xxhash64("text"))).select("id", "h", "base", "other"))
    seeds = seen.where(F.size("base") > 0).select("h", F.explode("base").alias("s")).select("h", "s.kind", "s.value", F.explode("s.contexts").alias("context"))
    words = seen.where(F.size("other") > 0).select("id", "h", F.explode("other").alias("s")).select("id", "h", "s.start", "s.end", "s.value", F.explode("s.contexts").alias("context"))

    def induced(seeds: DataFrame) -> DataFrame:
        return stored(
            seeds.groupBy("kind", "context")
            .agg(F.countDistinct("value").alias("seeds"), F.countDistinct("h").alias("texts"))
            .where((F.col("seeds") >= support) & (F.col("texts") >= support))
            .select("kind", "context")
        )

    known, instances = induced(seeds), None
    while True:
        near = stored(words.join(known, "context"))
        # a pattern without a candidate can add no span; the others go to a file, whose size tells the planner how to join
        patterns = stored(near.select("kind", "context").distinct())
        both = seeds.join(patterns, ["kind", "context"], "left_semi").select("kind", "context", "value", F.lit(True).alias("seed")).unionByName(
            near.select("kind", "context", "value", F.lit(False).alias("seed"))
        )
        edges = cut(both.groupBy("kind", "context", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
        # a total over some texts is a lower bound: what it rules out, the total over all texts would rule out too
        some = context_counts(texts.where(F.contains("text", F.lit("@"))), patterns)
        hopeful = stored(reachable(edges, some, confidence))
        totals = cut(context_counts(texts, hopeful))
        edges = cut(edges.join(reachable(edges, totals, confidence), ["kind", "context"], "left_semi"))
        trust, scores = score(edges, totals)
        sure = stored(
            near.join(trust.where(F.col("confidence") >= confidence), ["kind", "context"]).join(
                scores.where(F.col("score") >= confidence), ["kind", "value"]
            )
        )
        found = sure.select("kind", "value").distinct()
        instances = stored(found if instances is None else found.unionByName(instances).distinct())
        if instances.isEmpty():
            break
        # instances join the seeds wherever they stand; they never leave, so the patterns grow until none is new
        more = induced(seeds.unionByName(words.join(instances, "value").select("h", "kind", "value", "context")))
        if more.count() == known.count():
            break
        known = more
    chosen = sure.groupBy("id", "h", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    per = chosen.groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(
        F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")
    )
    slim = seen.select("id", "h", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    joined = slim.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    nothing = F.expr("CAST(array() AS array<struct<kind: int, start: int, end: int>>)")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("added", nothing).alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted and hashed, and all spans, of every document."""
    found = find_private(table(spark, sf_dir, "documents"))
    of_kind = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans")
    )


QUERIES = {"op8_private_data": op8_private_data}
ORACLES: dict[str, str] = {}
