"""Personal data: base patterns, and identifiers found through the words around them.

All in DataFrame functions. Base entities (e-mail, IP and phone numbers, payment cards) are matched by
regular expressions and checked. They are the seeds of a bootstrap: the words before and after a seed
are its lexical patterns; every token or group of digits that looks like an identifier is an instance of
the patterns around it. Patterns and instances form a graph that is scored in rounds, for each kind:

    trust(pattern) = P / (P + N + 1)
        P: the scores of its different instances of the kind, seeds and found ones
        N: its different instances that cannot be of the kind, and the scores of those of another kind
    score(instance) = 1 - product of (1 - trust) over its trusted patterns; 1 for seeds

Instances that nothing is known about count neither way: they are what the pattern is to find. A pattern
is trusted from enough different scored instances on, so what one round finds can make patterns
trusted in the next. New instances with a high score become spans wherever they stand in a trusted
pattern. The corpus is read once; the graph holds only tokens with digits or an at sign, and of those
only patterns with enough instances that could be of a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import bind
from logsift.llm.common import SPACE, text_key
from logsift.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
#: A pattern counts from this many scored instances on and with this trust; an instance with this score.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 5, 0.8, 0.9
CONTEXT = 80  # code points on either side in which the neighbouring words are looked for
OPEN, CLOSE, STOP, DOT = "\ue000", "\ue001", "\ue002", "\ue003"

# The base entities. The patterns are written without repeated groups, which Java
# matches by recursion, and with starts that cannot be retried inside a run, so time is linear.
LOCAL = "A-Za-z0-9._%+" + DOT + "-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
MAYBE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}

SPAN = "struct<kind:int,start:int,end:int>"
CANDIDATE = "struct<start:int,end:int,token:string>"
#: Tokens with a digit or an at sign, without the punctuation around them.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}]*[0-9@][^{SPACE}]*"
TRIM = r"""^[\p{Punct}&&[^+]]+|[\p{Punct}]+$"""


#: Digits in groups, parted by single signs or spaces; what stands apart by more is not one number.
GROUPS = r"(?<![A-Za-z0-9@])[+(]?[0-9][0-9().\x20-]*[0-9](?![A-Za-z0-9@])"
MAYBE_GROUPS = r"[0-9)]\x20[0-9(]"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, counted from the right, pass the check sum."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, place):
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2
        folded = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when(place % 2 == 0, folded).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return luhn(digits)
    return F.length(digits).between(10, 15)


def _marked(text: Column, pattern: str) -> Column:
    """Segments of a text: outside, match, outside, match, ..., outside."""
    marked = F.regexp_replace(text, f"(?:{pattern})", f"{OPEN}$0{CLOSE}")
    return F.split(marked, f"[{OPEN}{CLOSE}]")


def _spans(segments: Column, keep, made, kind: str) -> Column:
    """What ``made(start, match)`` gives for every match that ``keep`` accepts."""
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("spans"))

    def step(state, segment):
        use = state["inside"] & keep(segment)
        spans = F.when(use, F.concat(state["spans"], F.array(made(state["at"], segment).cast(kind))))
        return F.struct(
            (state["at"] + F.length(segment)).alias("at"),
            (~state["inside"]).alias("inside"),
            spans.otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(segments, start, step)["spans"]


def plain(text: Column) -> Column:
    """The text with the marker characters, which no pattern matches, replaced by another one."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE + DOT, STOP * 3)


def base_spans(text: Column) -> Column:
    """The checked base entities of a text of :func:`plain`: (kind, start, end) by start, then kind."""
    found = []
    empty = F.array().cast(f"array<{SPAN}>")
    for number, (name, pattern) in enumerate(PATTERNS.items()):
        own = text
        if name == "email":  # a dot that no label follows ends the host, but not the local part
            own = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", DOT)
        made = lambda at, m, k=number: F.struct(
            F.lit(k).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end")
        )
        spans = _spans(_marked(own, pattern), lambda m, n=name: _valid(n, m), made, SPAN)
        found.append(F.when(text.rlike(MAYBE[name]), spans).otherwise(empty))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return F.array_sort(F.concat(*found), order)


def candidates(text: Column) -> Column:
    """Digit groups, and tokens with a digit or an at sign outside of them, as (start, end, token).

    Punctuation around a token is left out.
    """

    def made(at, m):
        head = F.length(F.regexp_extract(m, r"^[\p{Punct}&&[^+]]*", 0))
        token = F.regexp_replace(m, TRIM, "")
        return F.struct((at + head).alias("start"), (at + head + F.length(token)).alias("end"), token.alias("token"))

    def group(at, m):
        return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("token"))

    none = F.array().cast(f"array<{CANDIDATE}>")
    is_group = lambda m: (
        m.contains(" ") & ~m.contains("  ") & F.length(_digits(m)).between(7, 19)
    )
    groups = F.when(text.rlike(MAYBE_GROUPS), _spans(_marked(text, GROUPS), is_group, group, CANDIDATE)).otherwise(none)
    tokens = _spans(_marked(text, TOKEN), lambda m: F.lit(True), made, CANDIDATE)
    apart = lambda g: F.filter(
        tokens, lambda t: ~F.exists(g, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))
    )
    return F.when(text.rlike("[0-9@]"), bind(groups, lambda g: F.concat(g, apart(g)))).otherwise(none)


def patterns_around(text: Column, start: Column, end: Column) -> Column:
    """Lexical patterns of a span: the two words before it, and one word on either side."""
    from_ = F.greatest(start - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, from_ + 1, start - from_))
    after = F.lower(F.substring(text, end + 1, F.lit(CONTEXT)))
    two = F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}\p{{Punct}}]*$", 0)
    two = F.regexp_replace(F.trim(F.regexp_replace(two, rf"[{SPACE}]+", " ")), "[0-9]+", "0")
    one = F.regexp_replace(F.regexp_extract(before, rf"([^{SPACE}]+)[{SPACE}\p{{Punct}}]*$", 1), "[0-9]+", "0")
    next_ = F.regexp_replace(F.regexp_extract(after, rf"^[\p{{Punct}}{SPACE}]*([^{SPACE}]+)", 1), "[0-9]+", "0")
    made = F.array(
        F.when(F.length(two) > 0, F.concat(F.lit("L2 "), two)),
        F.when((F.length(one) > 0) & (F.length(next_) > 0), F.concat(F.lit("LR "), one, F.lit(" _ "), next_)),
    )
    return F.filter(made, lambda p: p.isNotNull())


def shape_allows(kind: Column, token: Column) -> Column:
    """Whether a token could be of a kind at all."""
    n = F.length(_digits(token))
    only = token.rlike(r"^\+?[0-9().\x20-]+$")
    return (
        F.when(kind == 0, token.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == 1, token.rlike(r"^[0-9]+(?:[.:][0-9]+){3,}$"))
        .when(kind == 2, only & n.between(13, 19))
        .otherwise(only & n.between(7, 15))
    )


def _graph(edges: DataFrame) -> DataFrame:
    """(pattern, token, kind, seed, misfits) of the patterns that could ever be trusted.

    A row says that the token could be of the kind, or is a seed of it. ``misfits`` counts the pattern's
    different tokens that could not.
    """
    kinds = range(len(KINDS))
    seeds = [F.max(F.coalesce(F.col("kind") == k, F.lit(False))).alias(f"seed{k}") for k in kinds]
    tokens = edges.groupBy("pattern", "token").agg(*seeds)
    for k in kinds:
        tokens = tokens.withColumn(f"fits{k}", F.col(f"seed{k}") | shape_allows(F.lit(k), F.col("token")))
    tokens = materialize(tokens, "pattern-tokens")
    sizes = tokens.groupBy("pattern").agg(F.count("*").alias("size"), *[F.count_if(f"fits{k}").alias(f"n{k}") for k in kinds])
    enough = [F.col(f"n{k}") >= SUPPORT for k in kinds]
    sizes = materialize(sizes.filter(enough[0] | enough[1] | enough[2] | enough[3]), "patterns")
    rows = F.array(
        *[
            F.when(
                F.col(f"fits{k}") & enough[k],
                F.struct(
                    F.lit(k).alias("kind"),
                    F.col(f"seed{k}").alias("seed"),
                    (F.col("size") - F.col(f"n{k}")).alias("misfits"),
                ),
            )
            for k in kinds
        ]
    )
    rows = F.inline(F.filter(rows, lambda r: r.isNotNull()))
    return materialize(tokens.join(sizes, "pattern").select("pattern", "token", rows), "pattern-graph")


def _bootstrap(edges: DataFrame) -> DataFrame:
    """(pattern, token, kind) of trusted new identifiers, from edges (pattern, token, kind or null)."""
    graph = _graph(edges)
    seeds = edges.filter(F.col("kind").isNotNull()).select("token", "kind").distinct()
    seeds = materialize(seeds.select("token", F.col("kind").alias("known"), F.lit(1.0).alias("score")), "seeds")
    scores = seeds
    for _ in range(ROUNDS):
        same = F.col("known") == F.col("kind")
        # a seed of the kind does not speak against it if it is also one of another
        against = F.when(~same & ~F.col("seed"), F.col("score")).otherwise(0.0)
        trusted = (
            graph.join(scores, "token")
            .groupBy("pattern", "kind")
            .agg(
                F.sum(F.when(same, F.col("score")).otherwise(0.0)).alias("p"),
                F.count_if(same).alias("support"),
                (F.sum(against) + F.max("misfits")).alias("n"),
            )
            .withColumn("trust", F.col("p") / (F.col("p") + F.col("n") + 1))
            .filter((F.col("support") >= SUPPORT) & (F.col("trust") >= PATTERN_SCORE))
            .select("pattern", "kind", "trust")
        )
        trusted = materialize(trusted, "trusted")
        reached = graph.filter(~F.col("seed")).join(trusted, ["pattern", "kind"])
        scored = reached.groupBy("token", "kind").agg(
            F.round(1 - F.exp(F.sum(F.log(1 - F.col("trust")))), 9).alias("score")
        )
        best = F.max(F.struct("score", (-F.col("kind")).alias("last"))).alias("best")
        best = scored.filter(F.col("score") >= INSTANCE_SCORE).groupBy("token").agg(best)
        new = best.select("token", (-F.col("best.last")).alias("known"), F.col("best.score").alias("score"))
        new = materialize(new.join(seeds.select("token"), "token", "left_anti"), "found")
        scores = seeds.unionByName(new)
    named = new.select("token", F.col("known").alias("kind"))
    found = reached.select("pattern", "token", "kind").join(named, ["token", "kind"], "left_semi")
    return found.select("pattern", "token", "kind").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): spans (kind, start, end) of every row; kinds are numbered by ``KINDS``.

    Positions count code points, ends are exclusive. ``base`` holds the checked base entities,
    ``added`` the tokens that the bootstrap found and that overlap none of them. A null text has no
    spans. Rows with one id and one text share their spans; one row per row, none for an empty table.
    """
    text = F.col("__text")
    own = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tag"), plain(F.col(text_col)).alias("__text"))
    own = own.withColumn("base", base_spans(text)).withColumn("tokens", candidates(text))
    free = F.filter(
        "tokens",
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    around = lambda s: patterns_around(text, s["start"], s["end"])
    piece = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    none = F.lit(None).cast("int")
    marked = F.concat(
        F.transform(
            "base",
            lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lower(piece(b)).alias("token"), around(b).alias("patterns")),
        ),
        F.transform(
            free,
            lambda t: F.struct(none.alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lower(t["token"]).alias("token"), around(t).alias("patterns")),
        ),
    )
    rows = materialize(own.select("doc_id", "tag", "base", marked.alias("marked")), "personal")
    spots = rows.select("doc_id", "tag", F.explode("marked").alias("s")).select("doc_id", "tag", "s.*")
    edges = spots.select(F.explode("patterns").alias("pattern"), "token", "kind")
    found = materialize(_bootstrap(edges), "identifiers")
    hits = (
        spots.filter(F.col("kind").isNull())
        .select("doc_id", "tag", "start", "end", "token", F.explode("patterns").alias("pattern"))
        .join(found, ["pattern", "token"])
        .groupBy("doc_id", "tag", "start", "end")
        .agg(F.min("kind").alias("kind"))
    )
    added = hits.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.collect_list(F.struct("kind", "start", "end").cast(SPAN)).alias("added")
    )
    added = materialize(added, "added")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag"))
    return rows.join(added, same, "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans, order), text), ",")
