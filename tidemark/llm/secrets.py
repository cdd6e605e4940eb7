"""Secret scans: plain patterns, and multipart credentials linked by an interval join within scopes.

Three plain kinds are always reported. Weak parts (identifiers, secret-looking values, endpoints) are reported only
where complementary parts lie together: each part looks for the nearest parts of the other roles before and behind it,
and links if they lie within the scope. Native expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The plain kinds, in the order in which equal starts are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PLAIN = ("assign", "access", "hex")
SCOPE = 200

#: kind -> (role, pattern, group whose length counts, least length); a weak kind is reported only with complements.
KINDS = {
    "assign": ("secret", ASSIGN, 2, 6),
    "access": ("identifier", ACCESS, 0, 20),
    "hex": ("secret", HEX, 0, 24),
    "login": ("identifier", r"(?i)\b(user(?:name|_?id)?|login|account|client_?id)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9@+/_.-]+)", 2, 3),
    "phrase": ("secret", r"(?i)\b(pass(?:phrase|code)?|pwd|pin|auth|credential|private_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)", 2, 4),
    "opaque": ("secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": ("endpoint", r"\b(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3|jdbc:[a-z]+)://[^\x20\x09-\x0D\x22'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?\b", 0, 7),
}
ORDER = {k: i for i, k in enumerate(KINDS)}


def _found(text: Column, kind: str) -> Column:
    """Per match of ``kind``: characters since the last match, its length, whether it is long enough."""
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    return F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= least).alias("ok")))


def _suspect(text: Column) -> Column:
    """Texts that can hold any plain or weak part with a complement; endpoints alone link with nothing."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(x) for x in ("password", "passwd", "secret", "token", "apikey", "api_key")]) | text.contains("AKIA") | text.rlike(HEX) | text.rlike(KINDS["login"][1]) | text.rlike(KINDS["phrase"][1]) | text.rlike(KINDS["opaque"][1])


def _key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, kind, role, start, end) of every part, plain and weak; positions in code points, end exclusive."""
    rows = _key(docs, id_col, text_col).where(_suspect(F.col("text"))).dropDuplicates(["doc_id", "text_key"])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("role"), F.filter(_found(F.col("text"), k), lambda x: x["size"].isNotNull()).alias("found")) for k, v in KINDS.items()])
    hits = rows.select("doc_id", "text_key", F.explode(kinds).alias("k")).select("doc_id", "text_key", "k.kind", "k.role", F.posexplode("k.found").alias("i", "m"))
    run = W.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hits.select("doc_id", "text_key", "kind", "role", "m.size", "m.ok", F.sum(F.col("m.gap") + F.col("m.size")).over(run).alias("end"))
    return placed.where("ok").select("doc_id", "text_key", "kind", "role", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``found`` that have their complements within ``scope`` code points, as (…, kind, start, end).

    An identifier needs a secret and a secret an identifier; an endpoint needs both. Overlapping parts don't link.
    Along a text's starts and ends, each part sees of every role the latest start among parts that ended before it and
    the earliest start among parts that begin after it: no part in between can lie nearer, so a scope that repeats a
    part many times never becomes pairs.
    """
    key = ["doc_id", "text_key"]
    role, start = F.col("role"), F.col("start")
    # Of an end and a start at one place the end comes first: such parts touch and don't overlap.
    place = F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("opens")), F.struct(start.alias("at"), F.lit(1).alias("opens")))
    marks = found.select(*key, "kind", "role", "start", "end", F.explode(place).alias("m")).select(*key, "kind", "role", "start", "end", "m.*")
    so_far = lambda *by: W.partitionBy(*key).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    past, ahead = so_far("at", "opens"), so_far(F.desc("at"), F.desc("opens"))
    last = lambda r: F.max(F.when((role == r) & (F.col("opens") == 0), start)).over(past)
    following = lambda r: F.min(F.when((role == r) & (F.col("opens") == 1), start)).over(ahead)
    sides = marks.select("*", *[f(r).alias(f"{n}_{r}") for r in ("identifier", "secret") for n, f in (("last", last), ("next", following))])
    sides = sides.where(~F.col("kind").isin(*PLAIN))
    has = lambda r: F.max(F.coalesce(F.when(F.col("opens") == 1, start - F.col(f"last_{r}")).otherwise(F.col(f"next_{r}") - start) <= scope, F.lit(False)))
    seen = sides.groupBy(*key, "kind", role.alias("own"), "start", "end").agg(has("identifier").alias("i"), has("secret").alias("s"))
    whole = F.when(F.col("own") == "identifier", F.col("s")).when(F.col("own") == "secret", F.col("i")).otherwise(F.col("i") & F.col("s"))
    return seen.where(whole).select(*key, "kind", "start", "end")


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, plain, spans): arrays of struct<start, rank, kind, end>, sorted; rows only for texts with spans.

    ``plain`` holds the plain kinds, ``spans`` those and the linked weak parts.
    """
    found = parts(docs, id_col, text_col)
    plain = found.where(F.col("kind").isin(*PLAIN)).select("doc_id", "text_key", "kind", "start", "end")
    every = plain.unionByName(linked(found, scope))
    rank = F.create_map(*[F.lit(x) for k, v in ORDER.items() for x in (k, v)])[F.col("kind")]
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("kind"), F.col("end"))
    spans = every.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return spans.select("doc_id", "text_key", F.filter("spans", lambda x: x["kind"].isin(*PLAIN)).alias("plain"), "spans")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, plain, spans) for every row of ``docs``; empty arrays where there is none. A null text is empty."""
    s = secret_spans(docs, scope, id_col, text_col)
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    none = F.array().cast(kind)
    rows = _key(docs, id_col, text_col).select("doc_id", "text_key").alias("r")
    s = s.alias("s")
    on = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_key") == F.col("s.text_key"))
    return rows.join(s, on, "left").select("r.doc_id", F.coalesce(F.col("s.plain").cast(kind), none).alias("plain"), F.coalesce(F.col("s.spans").cast(kind), none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans get one. Other rows and columns stay as they are,
    whatever their names.

    Only texts that can hold a span are shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    flag = _suspect(text)
    odd = docs.where(flag).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), F.struct("*").alias("row"))
    s = secret_spans(docs, scope, id_col, text_col).select("doc_id", "text_key", "spans")
    j = odd.join(s, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")

    # Overlapping spans become one: a span opens a new stretch when it starts at or after all ends so far.
    def fold(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["end"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["b"]), joined).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("a"), x["end"].alias("b")))))

    j = j.select("row", F.aggregate(F.col("spans"), F.array().cast("array<struct<a:bigint,b:bigint>>"), fold).alias("gaps"))
    own = lambda c: F.col("row").getField(c)
    t = own(text_col)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("gaps"), i - 1)["b"]).cast("int")
    pieces = F.transform("gaps", lambda x, i: F.concat(F.substring(t, before(i) + 1, x["a"].cast("int") - before(i)), F.lit(mask)))
    rest = F.substring(t, F.element_at("gaps", -1)["b"].cast("int") + 1, F.length(t))
    masked = F.when(F.col("gaps").isNull(), t).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return docs.where(~flag).unionByName(j.select(*[(masked if c == text_col else own(c)).alias(c) for c in docs.columns]))
