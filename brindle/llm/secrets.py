"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pick

# The patterns of the three base kinds (Java syntax; letters of the keyword in either case).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

# Weak parts, reported only beside their complement.
IDENT = r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
WEAK = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
ENDPOINT = r"""(?<![A-Za-z0-9])(?i:https?|ftp|ssh|jdbc:[a-z]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
#: A blank line ends a scope.
BREAK = r"\n[\x20\t\r]*\n"

#: The kinds in the order of the result.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint", "break")


def _ok(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the kind counts."""
    return {
        "assign": lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 6,
        "access": lambda hit: F.char_length(hit) >= 20,
        "hex": lambda hit: F.char_length(hit) >= 24,
        "ident": lambda hit: F.char_length(hit) >= 8,
        "weak": lambda hit: (F.char_length(hit) >= 16) & hit.rlike("[a-z]") & hit.rlike("[A-Z]"),
        "endpoint": lambda hit: F.char_length(hit) >= 8,
        "break": lambda hit: F.lit(True),
    }[kind]


#: Each kind's pattern, and a cheaper one that every text with a counting match has.
PATTERNS = {
    "assign": (ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (ACCESS, r"AKIA[A-Z0-9]{16}"),
    "hex": (HEX, r"[0-9a-f]{24}"),
    "ident": (IDENT, IDENT),
    "weak": (WEAK, r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]{0,15}+(?<=[A-Za-z0-9+/_=-]{16})"),
    "endpoint": (ENDPOINT, "://"),
    "break": (BREAK, BREAK),
}


def _matches(text: Column, kind: str, wanted: Column) -> Column:
    """An array of (kind, i, gap, len, ok): each leftmost, non-overlapping match and the code points before it.

    The parts between the matches and the matches themselves come from the same pattern, so that their lengths add up
    to positions; no delimiter is put into the text.
    """
    pattern = PATTERNS[kind][0]
    ok = _ok(kind)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))

    def lengths(gap: Column, hit: Column) -> Column:
        return F.struct(F.char_length(gap).cast("long").alias("gap"), F.char_length(hit).cast("long").alias("len"), ok(hit).alias("ok"))

    def numbered(x: Column, i: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["ok"].alias("ok"))

    found = F.transform(F.zip_with(gaps, hits, lengths), numbered)
    return F.when(wanted, found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,ok:boolean>>"))


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) -> doc_id, tag, kind, start, end: the counting matches of every kind.

    Most texts match no cheap pattern and end here; identical rows of one doc_id fall together.
    """
    has = {k: F.col("text").rlike(PATTERNS[k][1]).alias(f"has_{k}") for k in KINDS[:-1]}
    seen = docs.select("*", *has.values())
    weak = F.col("has_ident") | F.col("has_weak") | F.col("has_endpoint")
    seen = seen.where(F.col("has_assign") | F.col("has_access") | F.col("has_hex") | weak)
    wanted = {k: F.col(f"has_{k}") for k in KINDS[:-1]} | {"break": weak}
    found = F.concat(*[_matches(F.col("text"), k, wanted[k]) for k in KINDS])
    rows = seen.select("doc_id", "tag", found.alias("found")).dropDuplicates(["doc_id", "tag"])
    rows = rows.select("doc_id", "tag", F.inline("found"))
    before = Window.partitionBy("doc_id", "tag", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    return rows.where("ok").select("doc_id", "tag", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _near(rows: DataFrame, roles: dict[str, Column]) -> DataFrame:
    """rows (doc_id, tag, kind, start, end, ...) -> the same rows, breaks with them, and for each role the column
    near_<role>: whether a part of that role that shares no character with the row stands in its scope.

    An interval join as two ordered passes: each part comes once by its start and once by its end. On the way up, at a
    part's start, the nearest part of the role that has ended is the best there is before it; on the way down, at its
    end, the nearest one that is yet to start. A break beyond that one parts the scopes. No pair is ever built.
    """
    is_break = F.col("kind") == KINDS.index("break")
    at = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("end").alias("at")), F.struct(F.lit(1).alias("side"), F.col("start").alias("at"))))
    told = rows.withColumns({f"is_{r}": c for r, c in roles.items()} | {"is_break": is_break}).select("*", at.alias("x")).select("*", "x.side", "x.at").drop("x")
    part = Window.partitionBy("doc_id", "tag")
    # where parts touch, the one that ends there comes before the one that starts, in either direction
    up = part.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    down = part.orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    ended, coming = F.col("side") == 0, F.col("side") == 1
    names = [*roles, "break"]
    told = told.withColumns({f"{r}_before": F.max(F.when(F.col(f"is_{r}") & ended, F.col("at"))).over(up) for r in names})
    told = told.withColumns({f"{r}_after": F.min(F.when(F.col(f"is_{r}") & coming, F.col("at"))).over(down) for r in names})
    near = {}
    for r in roles:
        left = coming & (F.coalesce("break_before", F.lit(-1)) <= F.col(f"{r}_before"))
        right = ended & (F.coalesce("break_after", F.lit(2**62)) >= F.col(f"{r}_after"))
        near[f"near_{r}"] = F.max(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    return told.groupBy(rows.columns).agg(*[v.alias(k) for k, v in near.items()])


def _linked(parts: DataFrame) -> DataFrame:
    """The base parts, and of the weak ones those with their complement in the same scope, however far: a weak token
    beside an identifier or an endpoint, an identifier beside a secret, an endpoint beside a secret and an identifier
    that itself stands beside a secret. What complements a part shares no character with it."""
    n = {k: i for i, k in enumerate(KINDS)}
    role = {
        "name": F.col("kind").isin(n["access"], n["ident"]),
        "secret": F.col("kind").isin(n["assign"], n["hex"], n["weak"]),
        "place": F.col("kind") == n["endpoint"],
    }
    rows = _near(parts, role)
    rows = _near(rows, {"paired": role["name"] & F.col("near_secret")})
    linked = (
        F.when(F.col("kind") <= n["hex"], True)
        .when(F.col("kind") == n["weak"], F.col("near_name") | F.col("near_place"))
        .when(F.col("kind") == n["ident"], F.col("near_secret"))
        .when(F.col("kind") == n["endpoint"], F.col("near_secret") & F.col("near_paired"))
        .otherwise(False)
    )
    return rows.where(linked).select("doc_id", "tag", "kind", "start", "end")


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: array<struct<start, kind, end>> by start, then kind (a number in KINDS);
    positions are code points, the end exclusive. `keep` names more columns of docs to carry along.

    Base kinds count by themselves. Weak ones (named identifiers, mixed-case tokens with digits, endpoints) count only
    when no blank line lies between them and complementary parts, which share no character with them. A null or empty text has
    no span; each repeated row gets its spans; other columns are ignored; an empty table gives none.
    """
    base = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tag = F.xxhash64("text").alias("tag")
    found = _linked(_parts(pick(docs).withColumn("tag", tag)))
    spans = found.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    spans = durable(spans, "spans").withColumnsRenamed({"doc_id": "found_id", "tag": "found_tag"})
    left = base.select(*[f"keep_{c}" for c in keep], "doc_id", tag)
    match = left["doc_id"].eqNullSafe(spans["found_id"]) & (left["tag"] == spans["found_tag"])
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = left.join(spans, match, "left")
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep if c != "doc_id"], "doc_id", F.coalesce("spans", none).alias("spans"))


def span_list(spans: Column, kinds: int) -> Column:
    """kind:start:end of the first `kinds` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(x: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))

    def wanted(x: Column) -> Column:
        return x["kind"] < kinds

    return F.array_join(F.transform(F.filter(spans, wanted), told), ",")


def count_of(spans: Column, kind: str) -> Column:
    def same(x: Column) -> Column:
        return x["kind"] == KINDS.index(kind)

    return F.size(F.filter(spans, same)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by one mark."""

    def grow(acc: Column, x: Column) -> Column:
        apart = F.struct(
            F.array_append(acc["out"], F.substring(text, acc["end"].cast("int") + 1, (x["start"] - acc["end"]).cast("int"))).alias("out"),
            x["end"].alias("end"),
        )
        joined = F.struct(acc["out"].alias("out"), F.greatest(acc["end"], x["end"]).alias("end"))
        return F.when((x["start"] < acc["end"]) | ((x["start"] == acc["end"]) & (F.size(acc["out"]) > 0)), joined).otherwise(apart)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("end"))

    def close(acc: Column) -> Column:
        rest = F.substring(text, acc["end"].cast("int") + 1, F.char_length(text))
        return F.array_join(F.array_append(acc["out"], rest), mark)

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, grow, close)).otherwise(text)
