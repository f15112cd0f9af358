"""Secrets, judged by who has them: corpus-wide ownership of candidate values.

All in DataFrame functions. Base patterns find assignments, access keys and long hexadecimal numbers. A
value that looks like a credential can still be an example that half the world has copied; a live one is
in the hands of one owner. So the hash of every candidate value is counted over the whole corpus, by
different repositories and different owners:

* *copied*: at least ``COPIED_OWNERS`` owners have the value;
* *owned*: fewer do, and the value looks live (:func:`looks_live`);
* everything else is left undecided.

Candidates are the values of base matches and free tokens. A free token counts when its value is also
the value of a base match somewhere, or when it is long and mixed as generated keys are. Owned free tokens
become new spans: a password that one file assigns is then found in another where it stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import bind
from logsift.llm.common import text_key
from logsift.sources.scratch import materialize

OPEN, CLOSE, STOP = "\ue000", "\ue001", "\ue002"

# The base patterns and their least lengths (of the value or the match).
KEYWORDS = "password|passwd|secret|token|api_?key"
HEAD = rf"""(?i:{KEYWORDS})["']?+\x20*+[:=]\x20*+["']?+"""
ASSIGN = rf"{HEAD}[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex")
PATTERNS = (ASSIGN, ACCESS, HEX)
LEAST = (8, 16, 32)
MAYBE = (rf"(?i:{KEYWORDS})", "AKIA[A-Z0-9]", HEX)

#: The kind of spans that the method adds, numbered after the base ones.
OWNED = "owned"
#: Free tokens: runs of these characters, at least so long, with a letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}+"
MAYBE_TOKEN = r"[0-9][A-Za-z+/_.=-]|[A-Za-z+/_.=-][0-9]"
COPIED_OWNERS = 3
#: Characters of which a live value has at least so many different ones; a generated key more.
LIVE_CHARACTERS, KEY_CHARACTERS, KEY_LENGTH = 6, 12, 20
PLACEHOLDER = r"(?i)example|sample|dummy|change_?me|placeholder|your|test|fake|1234567|abcdef|(.)\1{3}"

SPAN = "struct<kind:int,start:int,end:int>"


def plain(text: Column) -> Column:
    """The text with the marker characters, which no pattern matches, replaced by another one."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, STOP * 2)


def starts(lengths: Column) -> Column:
    """Running sums before each element. Summed in chunks of the square root, as every sum starts anew."""
    add = lambda numbers: F.aggregate(numbers, F.lit(0), lambda a, b: a + b)
    each = lambda c: F.sequence(F.lit(0), c - 1)

    def summed(chunks: Column) -> Column:
        sums = F.transform(chunks, add)
        firsts = bind(sums, lambda s: F.transform(s, lambda _, k: add(F.slice(s, 1, k))))
        return bind(
            firsts,
            lambda first: F.flatten(
                F.transform(
                    chunks,
                    lambda chunk, k: F.transform(chunk, lambda _, i: F.get(first, k) + add(F.slice(chunk, 1, i))),
                )
            ),
        )

    def cut(own: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(own).cast("double"))).cast("int"), F.lit(1))
        return bind(size, lambda c: bind(F.transform(each(c), lambda k: F.slice(own, k * c + 1, c)), summed))

    return bind(lengths, cut)


def matches(text: Column, pattern: str, maybe: str) -> Column:
    """(start, match) of all matches; ``maybe`` is a cheaper pattern that every match contains."""
    marked = F.regexp_replace(text, f"(?:{pattern})", f"{OPEN}$0{CLOSE}")
    segments = F.split(marked, f"[{OPEN}{CLOSE}]")  # outside, match, outside, match, ..., outside

    def inside(s: Column, at: Column) -> Column:
        all_ = F.transform(s, lambda m, i: F.struct(F.get(at, i).alias("start"), m.alias("match")))
        return F.filter(all_, lambda _, i: i % 2 == 1)

    found = bind(segments, lambda s: bind(starts(F.transform(s, F.length)), lambda at: inside(s, at)))
    return F.when(text.rlike(maybe), found).otherwise(F.array().cast("array<struct<start:int,match:string>>"))


def value_of(kind: int, match: Column) -> Column:
    return F.regexp_replace(match, f"^{HEAD}", "") if KINDS[kind] == "assign" else match


def value_key(value: Column) -> Column:
    """Hash of a value without the full stop that may end a sentence."""
    return F.unhex(F.md5(F.regexp_replace(value, r"\.+$", "").cast("binary")))


def characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def looks_live(value: Column) -> Column:
    """A digit, some different characters and nothing that says placeholder."""
    return value.rlike("[0-9]") & (characters(value) >= LIVE_CHARACTERS) & ~value.rlike(PLACEHOLDER)


def looks_generated(value: Column) -> Column:
    """Long, with small and capital letters and digits, as generated keys are."""
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("^[A-Za-z0-9_-]+$")
    return (F.length(value) >= KEY_LENGTH) & mixed & (characters(value) >= KEY_CHARACTERS)


def _candidate(kind: Column, start: Column, end: Column, value: Column, key: Column) -> Column:
    return F.struct(
        kind.cast("int").alias("kind"),
        start.alias("start"),
        end.alias("end"),
        value_key(value).alias("key"),
        looks_live(value).alias("live"),
        key.alias("generated"),
    )


def base_candidates(text: Column) -> Column:
    """The checked base matches of a text of :func:`plain`, by start, then kind."""

    def of_kind(kind: int) -> Column:
        value = lambda m: value_of(kind, m["match"])
        long_ = F.filter(matches(text, PATTERNS[kind], MAYBE[kind]), lambda m: F.length(value(m)) >= LEAST[kind])
        return F.transform(
            long_,
            lambda m: _candidate(F.lit(kind), m["start"], m["start"] + F.length(m["match"]), value(m), F.lit(False)),
        )

    return F.array_sort(F.concat(*[of_kind(kind) for kind in range(len(KINDS))]), in_order)


def free_candidates(text: Column, base: Column) -> Column:
    """Tokens with a letter and a digit that overlap no base match."""
    tokens = F.filter(matches(text, TOKEN, MAYBE_TOKEN), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]"))
    free = lambda m: ~F.exists(
        base, lambda b: (b["start"] < m["start"] + F.length(m["match"])) & (m["start"] < b["end"])
    )
    token = lambda m: F.regexp_replace(m["match"], r"\.+$", "")
    made = lambda m: bind(
        token(m), lambda t: _candidate(F.lit(None), m["start"], m["start"] + F.length(t), t, looks_generated(t))
    )
    return F.transform(F.filter(tokens, free), made)


def ownership(spots: DataFrame) -> DataFrame:
    """(key, n_repositories, n_owners) from (key, repository, owner); nulls count as one of each.

    Counted level by level: rows of a value that everybody has are combined on the map side and spread
    by repository, then by owner, and a task gets a few rows of it at most.
    """
    pairs = spots.groupBy("key", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("key", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("key").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
    copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """(doc_id, base, added, owned, copied) of every row; spans are (kind, start, end).

    ``base`` has the base matches, ``added`` owned free tokens (kind ``len(KINDS)``), ``owned`` and ``copied``
    the spans of either sort with that verdict. Positions count code points, ends are exclusive. A
    repository is a document and an owner a ``source`` unless expressions are given. A null text has no
    spans; rows with one id and one text share their spans, whatever else they hold, and each of them
    counts for ownership. A null owner or repository counts as one. An empty table gives no rows.
    """
    quoted = lambda name: F.col(f"`{name.replace('`', '``')}`")
    text = F.col("__text")
    own = docs.select(
        quoted(id_col).alias("doc_id"),
        text_key(quoted(text_col)).alias("tag"),
        (quoted(id_col) if repository is None else repository).alias("repository"),
        (F.col("source") if owner is None else owner).alias("owner"),
        plain(quoted(text_col)).alias("__text"),
    )
    own = own.withColumn("base", base_candidates(text))
    own = own.withColumn("free", free_candidates(text, F.col("base"))).drop("__text")
    rows = materialize(own, "secret-candidates")

    keys = ("doc_id", "tag", "repository", "owner")
    base = rows.select(*keys, F.inline("base"))
    free = rows.select(*keys, F.inline("free"))
    known = materialize(base.select("key").distinct(), "known-values")
    named = free.filter(~F.col("generated")).join(known, "key", "left_semi").select(*base.columns)
    spots = materialize(base.unionByName(free.filter("generated")).unionByName(named), "secret-spots")
    counted = materialize(ownership(spots), "owners")

    is_copied = F.col("n_owners") >= copied_owners
    is_owned = ~is_copied & F.col("live")
    span = F.struct(F.coalesce("kind", F.lit(len(KINDS))).alias("kind"), "start", "end")
    chosen = spots.join(counted, "key").filter(is_copied | is_owned)
    lists = chosen.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.collect_set(F.when(F.col("kind").isNull() & is_owned, span)).alias("added"),
        F.collect_set(F.when(is_owned, span)).alias("owned"),
        F.collect_set(F.when(is_copied, span)).alias("copied"),
    )
    lists = materialize(lists, "judged-spans")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag"))
    spans = lambda name: F.array_sort(F.coalesce(name, F.array().cast(f"array<{SPAN}>")), in_order).alias(name)
    base_spans = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return rows.join(lists, same, "left").select(
        "doc_id", base_spans.alias("base"), spans("added"), spans("owned"), spans("copied")
    )


def in_order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, OWNED)])
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans, in_order), text), ",")
