"""Information-theoretic sanitisation, in DataFrame operations only.

Pattern matches (addresses, card and phone numbers) are the protected entities. The corpus tells how
strongly a term reveals an entity: with n(e) distinct contexts of entity e, n(e, t) of them holding
term t, n(t) occurrences of t and N of all words in distinct texts, the disclosed share of e's information is

    PMI(e; t) / IC(e) = log(n(e, t) N / (n(e) n(t))) / log(N / n(e)).

Terms with a share of at least ``DISCLOSURE`` and ``SUPPORT`` distinct contexts are generalised in every
document that holds the entity, and removed from ``REMOVAL`` on. Copies of a context and of a text count
once, so a copied document reveals and hides nothing by its copies. (After Sanchez and Batet's C-sanitized model.)

An exact match seldom recurs. What it shares with others does: the host and the name of an address, the
net of an IP address, the first digits of a number. Each of these is an entity as well, with its own
contexts, and a document that holds a match holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.llm.tables import safe_text

#: Kinds in the order of ties. The expressions match what the plain ones of the contract match. They
#: never step back and start once per run of characters, so long runs cost their length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
KINDS = tuple(PATTERNS)
TERM = "term"
WINDOW = 80
SHORTEST_TERM = 3
SUPPORT = 3
DISCLOSURE, REMOVAL = 0.7, 0.95
#: Steps that are folded into one array, and code points that are searched for a place.
CHUNK, PIECE = 128, 4096
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _states(items: Column, first: Column, step, kind: str) -> Column:
    """The states after each item, as an array."""
    empty = F.array().cast(f"array<{kind}>")

    def advance(done: Column, item: Column) -> Column:
        return _let(step(done["at"], item), lambda now: F.struct(now.alias("at"), F.concat(done["all"], F.array(now)).alias("all")))

    return F.aggregate(items, F.struct(first.alias("at"), empty.alias("all")), advance, lambda done: done["all"])


def _running(steps: Column, start: Column, add, kind: str) -> Column:
    """``add(state, step)`` after every step, for a state that starts with ``start``, as an array.

    Appending to an array copies it, so steps are cut into chunks: the states at their ends are folded
    first, then every chunk by itself.
    """

    def in_chunks(own: Column) -> Column:
        heads = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return _let(F.transform(heads, lambda at: F.slice(own, at, F.lit(CHUNK))), folded)

    def folded(chunks: Column) -> Column:
        ends = _states(chunks, start, lambda at, chunk: F.aggregate(chunk, at, add), kind)
        starts = F.slice(F.concat(F.array(start), ends), F.lit(1), F.size(chunks))
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, first: _states(chunk, first, add, kind)))

    return _let(steps, in_chunks)


def located(text: Column, pattern: Column, kind: int, matches: Column) -> Column:
    """Matches of a pattern with their places (code points), from the lengths of what lies between."""

    def places(found: Column) -> Column:
        lengths = F.zip_with(
            F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, own: F.char_length(gap) + F.char_length(own)
        )
        ends = _running(lengths, F.lit(0), lambda at, length: at + length, "int")
        return F.zip_with(
            ends, found,
            lambda end, value: F.struct(
                (end - F.char_length(value)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")
            ),
        ).cast(_SPAN)

    return _let(matches, places)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _valid_match(kind: str):
    return lambda value: _valid(kind, value)


def _valid_span(kind: str):
    return lambda span: _valid(kind, span["value"])


def with_base_spans(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_base``: the valid matches of all kinds in order of start, then kind."""
    none = F.array().cast("array<string>")
    matched = []
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        worth = F.contains(F.col(text), F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.lit(True)
        matched.append(F.when(worth, found).otherwise(none).alias(f"_m_{kind}"))
    step = df.select(*keep, *matched)
    spans = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        own = F.col(f"_m_{kind}")
        # Only texts with a valid match are searched for its place.
        any_valid = F.exists(own, _valid_match(kind))
        places = F.when(any_valid, located(F.col(text), F.lit(pattern), number, own)).otherwise(F.array().cast(_SPAN))
        spans.append(F.filter(places, _valid_span(kind)))
    return step.select(*keep, F.sort_array(F.concat(*spans)).alias("_base"))


def _entities(span: Column) -> Column:
    """What a match is an instance of: itself, and what it shares with others (see the top)."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    shared = [
        F.when(kind == 0, F.concat(F.lit("host:"), F.substring_index(value, "@", -1))),
        F.when(kind == 0, F.concat(F.lit("name:"), F.substring_index(value, "@", 1))),
        F.when(kind == 1, F.concat(F.lit("net:"), F.substring_index(value, ".", 3))),
        F.when(kind == 2, F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))),
        F.when(kind == 3, F.concat(F.lit("area:"), F.substring(digits, 1, 5))),
    ]
    return F.array_compact(F.array(F.concat_ws(":", kind.cast("string"), value), *shared))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters of at least ``SHORTEST_TERM`` code points."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{SHORTEST_TERM},}}+"), F.lit(0))


def _pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points. To find a place, Spark counts code points from the start,
    so a long text is cut once and places are looked for inside a piece."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (0-based) on."""
    first = F.floor(start / F.lit(PIECE)).cast("int")
    last = F.floor((start + length) / F.lit(PIECE)).cast("int")
    held = F.array_join(F.slice(pieces, first + F.lit(1), last - first + F.lit(1)), "")
    return F.substring(held, start - first * F.lit(PIECE) + F.lit(1), length)


def _context(pieces: Column, span: Column) -> Column:
    """Whole words on both sides of a span, without words that hold digits or an at sign."""
    low = F.greatest(span["start"] - F.lit(WINDOW), F.lit(0))
    left = _part(pieces, low, span["start"] - low)
    right = _part(pieces, span["end"], F.lit(WINDOW))
    left = F.when(low > 0, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(F.char_length(right) == WINDOW, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return F.array_distinct(words_of(F.regexp_replace(F.concat_ws(" ", left, right), r"\S*[0-9@]\S*", " ")))


def contexts_of(texts: DataFrame) -> DataFrame:
    """Of every distinct text with a match: its ``_key`` (128 bits) and, per match, entities and terms
    around it, as a written table. ``texts`` has the column ``_text``."""
    found = with_base_spans(texts, "_text", ["_text"]).where(F.size("_base") > 0)
    found = found.select("_text", "_base", _pieces(F.col("_text")).alias("_pieces"))
    around = lambda span: F.struct(_entities(span).alias("entities"), _context(F.col("_pieces"), span).alias("terms"))
    rows = found.select(_key().alias("_key"), F.transform("_base", around).alias("seen"))
    return materialize(rows.dropDuplicates(["_key"]))


def _key() -> Column:
    return F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit("key"), "_text").alias("b"))


def disclosing_terms(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``entity``, ``term`` and ``share`` of every pair at or above the thresholds, over all texts
    (column ``_text``). ``known`` are their contexts, if they are at hand."""
    known = contexts_of(docs) if known is None else known
    opened = known.select(F.explode("seen").alias("seen"))
    contexts = materialize(opened.select(F.explode("seen.entities").alias("entity"), "seen.terms").distinct())
    seen = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= SUPPORT)
    joint = (
        contexts.select("entity", F.explode("terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_joint"))
        .where(F.col("n_joint") >= SUPPORT)
    )
    joint = materialize(joint.join(seen, "entity"))
    candidates = joint.select("term").distinct().withColumn("known", F.lit(True))
    words = docs.select("_text").distinct().select(F.explode(words_of(F.col("_text"))).alias("term"))
    counted = (
        dimension_join(words, candidates, ["term"], "left", spread_by=["term"])
        .groupBy(F.when(F.col("known"), F.col("term")).alias("term"))
        .agg(F.count(F.lit(1)).alias("n_term"))
    )
    counted = materialize(counted)
    total = F.lit(counted.agg(F.sum("n_term")).first()[0] or 1)
    information = F.log(total / F.col("n_entity"))
    share = F.log(F.col("n_joint") * total / (F.col("n_entity") * F.col("n_term"))) / information
    return (
        joint.join(counted, "term")
        .withColumn("share", F.when(information > 0, share))
        .where(F.col("share") >= DISCLOSURE)
        .select("entity", "term", "share")
    )


def with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``_text``, ``_base`` and ``_terms`` (spans; ``kind`` 0: generalised, 1: removed)."""
    texts = docs.withColumn("_text", safe_text(F.col("text")))
    known = contexts_of(texts.select("_text"))
    disclosing = materialize(disclosing_terms(texts.select("_text"), known))
    marked = with_base_spans(texts, "_text", [*keep, "_text"])
    if disclosing.isEmpty():
        return marked.select(*keep, "_text", "_base", F.array().cast(_SPAN).alias("_terms"))
    marked = marked.withColumn("_key", F.when(F.size("_base") > 0, _key()))
    holders = known.select("_key", F.explode("seen.entities").alias("_own")).select("_key", F.explode("_own").alias("entity")).distinct()
    per_text = (
        dimension_join(holders, disclosing, ["entity"], spread_by=["_key"])
        .groupBy("_key", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("_key")
        .agg(F.collect_list(F.struct("term", "share")).alias("_listed"))
    )
    joined = dimension_join(marked, per_text, ["_key"], "left", spread_by=["_text"])
    # Terms hold letters only, so they can stand in an expression as they are.
    listed = F.array_join(F.transform("_listed", lambda x: x["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), listed, F.lit(r")(?!\p{L})"))
    matches = F.regexp_extract_all(F.col("_text"), F.col("_pattern"), F.lit(0))
    strong = F.transform(F.filter("_listed", lambda x: x["share"] >= REMOVAL), lambda x: x["term"])
    step = joined.withColumn("_pattern", F.when(F.col("_listed").isNotNull(), pattern)).withColumn(
        "_found", F.when(F.col("_pattern").isNotNull(), located(F.col("_text"), F.col("_pattern"), 0, matches))
    )
    free = lambda term: ~F.exists("_base", lambda b: (b["start"] < term["end"]) & (term["start"] < b["end"]))
    graded = F.transform(
        F.filter(F.coalesce("_found", F.array().cast(_SPAN)), free),
        lambda x: x.withField("kind", F.array_contains(strong, F.lower(x["value"])).cast("int")),
    )
    return step.select(*keep, "_text", "_base", graded.cast(_SPAN).alias("_terms"))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _all_spans() -> Column:
    """Base spans and terms in one order; a term comes after any base kind at the same start."""
    terms = F.transform("_terms", lambda s: s.withField("kind", F.lit(len(KINDS))))
    return F.sort_array(F.concat("_base", terms))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans of every document.

    Spans are ``kind:start:end`` in code points, ends exclusive, by start, then kind. A null text
    counts as empty and has none. Repeated rows give repeated rows. Columns other than ``doc_id``
    and ``text`` are not read; an empty table gives no rows.
    """
    marked = with_spans(docs.select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("bigint")
    return marked.select(
        "doc_id",
        *[count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)],
        F.sha2(_shown(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _shown(_all_spans()).alias("spans"),
        F.size("_terms").cast("bigint").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by ``[KIND]``, terms by ``[TERM]`` or nothing.

    ``text`` and, if there is one, ``n_chars`` change in documents with spans only; nulls stay null.
    Overlapping spans become one, with the label of the first. All other columns come back as they
    are, whatever their names: inside, columns go by number. An empty table gives no rows.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner))
    plain = docs.toDF(*inner)
    marked = with_spans(plain.withColumn("text", F.col(own["text"])), inner)
    labels = F.array(*[F.lit(f"[{kind.upper()}]") for kind in (*KINDS, TERM)], F.lit(""))
    terms = F.transform("_terms", lambda s: s.withField("kind", s["kind"] + F.lit(len(KINDS))))
    spans, text, cut = F.col("_spans"), F.col("_text"), F.col("_pieces")
    # Up to where the text is used up before each span, and after the last one.
    used = F.concat(F.array(F.lit(0)), _running(spans, F.lit(0), lambda at, span: F.greatest(at, span["end"]), "int"))
    step = marked.withColumn("_spans", F.sort_array(F.concat("_base", terms)))
    step = step.withColumns({"_used": F.when(F.size(spans) > 0, used), "_pieces": F.when(F.size(spans) > 0, _pieces(text))})
    before = lambda i: F.get("_used", i)
    pieces = F.transform(
        spans,
        lambda span, i: F.when(
            span["start"] >= before(i),
            F.concat(_part(cut, before(i), span["start"] - before(i)), F.get(labels, span["kind"])),
        ).otherwise(F.lit("")),
    )
    rest = F.substring(text, F.element_at("_used", -1) + F.lit(1), F.char_length(text))
    cleaned = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(own["text"]))
    step = step.withColumn("_new", cleaned)
    out = []
    for name, column in own.items():
        shown = F.col(column)
        if name == "text":
            shown = F.col("_new")
        elif name == "n_chars":
            shown = F.when(F.size(spans) > 0, F.char_length("_new")).otherwise(shown).cast(docs.schema[name].dataType)
        out.append(shown.alias(name))
    return step.select(*out)
