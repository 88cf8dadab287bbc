"""Secret scan with multipart credential linking, in DataFrame functions only.

Three patterns give the certain findings. Weaker parts are identifiers (user names and the like, e-mail addresses, access
ids too short to report), secrets (40 characters of base64, assigned values and hex too short to report) and endpoints
(URLs, host:port, hosts, IPv4 addresses). They are reported only where complementary parts stand within SCOPE
characters: an identifier needs a secret, a secret an identifier, an endpoint both. Parts become intervals, and an
equi-join on scope cells with a check of distance links them. Distance is between starts.

Rows: one for each input row. A null text counts as empty. Repeated rows give equal results. Positions are code
points, ends exclusive. Spans of one kind do not overlap; spans of different kinds may. Only ``doc_id`` and the text
column are read; other columns travel as one value, so their names cannot clash. A text is joined with its own parts
only (by doc_id and md5).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, cut, null_safe_text


@dataclass(frozen=True)
class Kind:
    pattern: str
    role: str
    certain: bool = False
    #: Length of group 2 that a match must have, and the first length that it must not have.
    least: int = 0
    below: int = 1 << 30


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds in the order in which spans of one start are listed.
KINDS = {
    "assign": Kind(ASSIGN, "secret", True, least=6),
    "access": Kind(r"AKIA[A-Z0-9]{16,}", "id", True),
    "hex": Kind(r"[0-9a-f]{24,}", "secret", True),
    "weak_id": Kind(r"""\b(?i:(?:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", "id"),
    "email": Kind(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@" + _HOST, "id"),
    "short_access": Kind(r"AKIA[A-Z0-9]{4,15}(?![A-Z0-9])", "id"),
    "weak_secret": Kind(r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", "secret"),
    "short_assign": Kind(ASSIGN, "secret", below=6),
    "short_hex": Kind(r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{12,23}(?![0-9A-Za-z])", "secret"),
    "endpoint": Kind(r"""\b(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|redis|mongodb|amqp|ftp|ssh)://[^\s"'<>]+""", "endpoint"),
    "host_port": Kind(r"(?<![A-Za-z0-9.@/-])" + _HOST + r":[0-9]{2,5}(?![0-9])", "endpoint"),
    "ipv4": Kind(r"(?<![0-9.])" + _BYTE + r"(?:\." + _BYTE + r"){3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])", "endpoint"),
    "host": Kind(r"(?<![A-Za-z0-9.@/-])" + _HOST + r"(?![A-Za-z0-9-]|\.[A-Za-z0-9]|:[0-9])", "endpoint"),
}
CERTAIN = tuple(k for k, x in KINDS.items() if x.certain)
WEAK = tuple(k for k, x in KINDS.items() if not x.certain)
#: A weak part is reported where a part of every one of these roles is near.
NEEDS = {"id": ("secret",), "secret": ("id",), "endpoint": ("id", "secret")}
#: Characters within which parts belong together.
SCOPE = 200
#: Matches whose places are added up at a time; the sums are then added up in turn, so cost grows with the matches.
STEP = 128

_SPANS = "array<struct<start:int,nth:int,end:int,kind:string>>"


def any_of(role: str) -> str:
    """A pattern for texts that may hold a part of this role."""
    return "|".join(f"(?:{p})" for p in dict.fromkeys(k.pattern for k in KINDS.values() if k.role == role))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def find_spans(text: Column, kind: str, order: int) -> Column:
    """Array of (start, nth, end, kind) of one pattern's matches: their lengths and those of the pieces between, added up in steps."""
    rule = KINDS[kind]
    checked = rule.least > 0 or rule.below < 1 << 30

    def part(found: Column, gap: Column) -> Column:
        fits = F.length(F.regexp_extract(found, rule.pattern, 2)).between(rule.least, rule.below - 1) if checked else found.isNotNull()
        return F.struct(F.length(gap).alias("gap"), F.length(found).alias("size"), F.coalesce(fits & found.isNotNull(), F.lit(False)).alias("fits"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("nth"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["fits"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast(_SPANS)
    placed = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)
    starts = lambda done: F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list")), lambda s, d: F.struct((s["at"] + d["at"]).alias("at"), F.concat(s["list"], F.array(s["at"])).alias("list")))["list"]
    moved = lambda d, start: F.transform(d["spans"], lambda s: s.withField("start", s["start"] + start).withField("end", s["end"] + start))
    in_steps = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STEP).cast("int")), lambda c: placed(F.slice(p, c * STEP + 1, STEP)))
    # The piece after the last match has no match beside it and fits nothing.
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1), part)
    spans = _bound(parts, lambda p: _bound(in_steps(p), lambda done: F.flatten(F.zip_with(done, starts(done), moved))))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(text: Column, kinds: tuple[str, ...]) -> Column:
    """All spans of these kinds, as (start, nth, end, kind)."""
    return F.concat(*[find_spans(text, kind, i) for i, kind in enumerate(KINDS) if kind in kinds])


def linked_spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_md5, added) of the texts in found (doc_id, text_md5, base, weak) whose weak parts have what they need near."""
    role = F.create_map(*[F.lit(x) for kind, rule in KINDS.items() for x in (kind, rule.role)])
    with_weak = found.where(F.size("weak") > 0).select("doc_id", "text_md5", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    parts = with_weak.select("doc_id", "text_md5", "s.*", role[F.col("s.kind")].alias("role"))
    # Of each role only the first and last part of a cell can be the nearest from another cell.
    cell = F.floor(F.col("start") / scope)
    cells = parts.groupBy("doc_id", "text_md5", cell.alias("cell"), "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    near = parts.where(~F.col("kind").isin(*CERTAIN)).select("*", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"))
    same_text = F.col("n.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("n.text_md5") == F.col("c.text_md5")) & (F.col("n.cell") == F.col("c.cell"))
    ends_near = (F.abs(F.col("c.lo") - F.col("n.start")) <= scope) | (F.abs(F.col("c.hi") - F.col("n.start")) <= scope)
    within = (F.col("c.role") != F.col("n.role")) & (ends_near | F.col("n.start").between(F.col("c.lo"), F.col("c.hi")))
    linked = near.alias("n").join(cells.alias("c"), same_text & within).groupBy("n.doc_id", "n.text_md5", "n.start", "n.nth", "n.end", "n.kind", "n.role").agg(F.collect_set("c.role").alias("roles"))
    enough = F.lit(False)
    for mine, roles in NEEDS.items():
        enough = enough | ((F.col("role") == mine) & (F.size(F.array_intersect("roles", F.array(*map(F.lit, roles)))) == len(roles)))
    return linked.where(enough).groupBy("doc_id", "text_md5").agg(F.collect_list(F.struct("start", "nth", "end", "kind")).alias("added"))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, text_md5, base (array of certain spans) and added (array of linked weak spans) of every row; texts are searched once."""
    body = null_safe_text(text)
    # Nothing links in a text without an identifier and a secret.
    weak = F.when(body.rlike(any_of("secret")) & body.rlike(any_of("id")), spans_of(body, WEAK)).otherwise(F.array().cast(_SPANS))
    found = cut(docs.select("doc_id", F.md5(body).alias("text_md5"), spans_of(body, CERTAIN).alias("base"), weak.alias("weak")))
    # A written table has a known size: few linked texts are broadcast.
    added = Written(docs.sparkSession)(linked_spans(found, scope))
    same = F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.text_md5") == F.col("a.text_md5"))
    return found.alias("f").join(added.alias("a"), same, "left").select("f.doc_id", "f.text_md5", "f.base", F.coalesce("a.added", F.array().cast(_SPANS)).alias("added"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every reported span of ``text`` replaced by the mark (spans that meet or overlap by one) and n_chars, where there is one, set anew."""
    spans = F.array_sort(F.concat("base", "added"))
    hits = Written(docs.sparkSession)(scan(docs).select("doc_id", "text_md5", spans.alias("spans")).where(F.size("spans") > 0).distinct())
    body = null_safe_text()

    def step(state: Column, span: Column) -> Column:
        gap = F.when(span["start"] > state["at"], F.struct(state["at"].alias("from"), span["start"].alias("to")))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["gaps"], F.when(gap.isNotNull() | (F.size(state["gaps"]) == 0), F.array(F.coalesce(gap, F.struct(F.lit(0).alias("from"), F.lit(0).alias("to"))))).otherwise(F.array().cast("array<struct<from:int,to:int>>"))).alias("gaps"))

    # What stays between the marks, then what stays at the end.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("gaps"))
    stays = F.aggregate("spans", start, step)
    piece = lambda text, a, b: F.substring(text, a + 1, b - a)
    clean = lambda text: _bound(stays, lambda s: F.concat(F.array_join(F.transform(s["gaps"], lambda g: F.concat(piece(text, g["from"], g["to"]), F.lit(mark))), ""), F.substring(text, s["at"] + 1, F.length(text))))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_doc"), F.md5(body).alias("row_md5"))
    same = F.col("d.row_doc").eqNullSafe(F.col("h.doc_id")) & (F.col("d.row_md5") == F.col("h.text_md5"))
    joined = row.alias("d").join(hits.alias("h"), same, "left")
    text = F.col("row")["text"]
    text = F.when(F.col("spans").isNotNull(), clean(text)).otherwise(text)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return joined.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in CERTAIN],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secrets": op1_secrets}
ORACLES: dict[str, str] = {}
