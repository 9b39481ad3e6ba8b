"""Secret scans with multipart linking, in DataFrame expressions throughout.

Base findings stand alone: assignments of a keyword, access identifiers, hexadecimal
runs. Weak parts (short or loosely named secrets, user names and key ids, endpoints) are
reported only if a secret and a part that completes it, an access identifier, another identifier
or an endpoint, lie within a scope of ``SCOPE`` characters of each other and do not overlap. Weak
keywords begin where no letter or digit stands before them. Parts are joined as intervals: each is spread over the cells of
the text that it (or its scope) touches and meets the others on (text, cell), so a long
text with many parts is many small groups. Copies of a text are scanned where they lie, but
their parts meet once, under a digest of the text.

Positions count code points, end exclusive. A pattern's matches are leftmost and don't
overlap. Null text counts as empty and has no findings. Repeated rows have equal findings.
Spans of different kinds may overlap, and all are listed; ties of start go by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routescope.llm.tables import saved


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# A weak keyword's match takes the character before it along, which ``_spans`` leaves out again.
EDGE = "(?:^|[^A-Za-z0-9])"


def _keyed(words: tuple[str, ...], value: str) -> str:
    return "(" + "|".join(map(either_case, words)) + r""")["']?\x20*[:=]\x20*["']?(""" + value + ")"


# The base kinds, in order, as given; then the weak parts.
ASSIGN = _keyed(("password", "passwd", "secret", "token", "api_?key"), "[A-Za-z0-9+/_.=-]+")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # runs are maximal, so shorter ones needn't be matched and dropped
NAMED = EDGE + _keyed(("pwd", "pass", "passphrase", "client_?secret", "private_?key"), "[A-Za-z0-9+/_.=!@#$%-]{6,}")
IDENTIFIER = EDGE + _keyed(("user", "username", "login", "account", "client_?id", "access_?key", "access_?key_?id"), "[A-Za-z0-9+/_.@=-]{3,}")
ENDPOINT = r"""(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\n\t"'<>]+"""
KINDS = ("assign", "access", "hex", "short_assign", "named", "identifier", "endpoint")
SECRETS = ("assign", "short_assign", "named")
OTHERS = ("access", "identifier", "endpoint")
EDGED = ("named", "identifier")
SCOPE, CELL = 200, 256
LEAST_ASSIGN, LEAST_SHORT, LEAST_ACCESS = 12, 6, 18


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    """Start, end and text of each match, from the lengths of the gaps between them."""
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        one = F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("end"), x["hit"].alias("hit")))
        return F.struct((begin + x["size"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, walked).otherwise(empty)


def _spans(found: Column, kind: str) -> Column:
    def skip(s: Column) -> Column:
        return F.when(s["hit"].rlike("^[A-Za-z]"), 0).otherwise(1) if kind in EDGED else F.lit(0)

    return F.transform(found, lambda s: F.struct((s["start"] + skip(s)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, a digest of the text, and ``base`` and ``weak`` spans (start, rank of kind, end), without the text."""
    text = F.col("__text")
    patterns = {"a": ASSIGN, "k": ACCESS, "h": HEX, "n": NAMED, "i": IDENTIFIER, "e": ENDPOINT}
    keyed = text.contains("=") | text.contains(":")
    possible = {"a": keyed, "n": keyed, "i": keyed, "k": text.contains("AKIA"), "e": text.contains("://"), "h": F.lit(True)}  # what every match holds
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    hits = {k: F.when(possible[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, p in patterns.items()}
    rows = rows.select("*", *[h.alias(f"__{k}") for k, h in hits.items()])
    rows = rows.select(*keep, "__text", *[_placed(text, p, F.col(f"__{k}")).alias(f"__{k}") for k, p in patterns.items()])
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2))
    strong = F.filter("__a", lambda s: value(s) >= LEAST_ASSIGN)
    short = F.filter("__a", lambda s: value(s).between(LEAST_SHORT, LEAST_ASSIGN - 1))
    access = F.filter("__k", lambda s: s["end"] - s["start"] >= LEAST_ACCESS)
    base = F.concat(_spans(strong, "assign"), _spans(access, "access"), _spans(F.col("__h"), "hex"))
    weak = F.concat(_spans(short, "short_assign"), _spans(F.col("__n"), "named"), _spans(F.col("__i"), "identifier"), _spans(F.col("__e"), "endpoint"))
    return rows.select(*keep, F.unhex(F.md5("__text")).alias("__key"), F.array_sort(base).alias("base"), weak.alias("weak"))


def linked(scans: DataFrame) -> DataFrame:
    """(__key, linked): weak spans of each text that a complementary part lies near."""
    many = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"]))
    parts = (
        scans.where(F.size("weak") > 0).select("__key", F.explode(F.concat(many, F.col("weak"))).alias("s"))
        .select("__key", "s.start", "s.rank", "s.end").distinct()
    )
    ranks = lambda kinds: [KINDS.index(k) for k in kinds]
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL)))
    secrets = parts.where(F.col("rank").isin(ranks(SECRETS))).withColumn("cell", cells(F.col("start"), F.col("end")))
    others = parts.where(F.col("rank").isin(ranks(OTHERS))).withColumn("cell", cells(F.col("start") - SCOPE, F.col("end") + SCOPE))
    s, o = secrets.alias("s"), others.alias("o")
    apart = (F.col("s.start") >= F.col("o.end")) | (F.col("o.start") >= F.col("s.end"))
    near = (F.col("s.start") - F.col("o.end") <= SCOPE) & (F.col("o.start") - F.col("s.end") <= SCOPE) & apart
    pairs = s.join(o, (F.col("s.__key") == F.col("o.__key")) & (F.col("s.cell") == F.col("o.cell")) & near)
    ends = pairs.select(F.col("s.__key").alias("__key"), F.explode(F.array(*[F.struct(F.col(f"{x}.start").alias("start"), F.col(f"{x}.rank").alias("rank"), F.col(f"{x}.end").alias("end")) for x in "so"])).alias("s"))
    weak = ends.where(F.col("s.rank") >= KINDS.index("short_assign")).distinct()
    return weak.groupBy("__key").agg(F.collect_list("s").alias("linked"))


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with its ``base`` spans and ``spans``, base and linked."""
    scans = saved(scanned(docs, keep), "secrets")
    return _with_links(scans).drop("__key", "weak")


def _with_links(scans: DataFrame) -> DataFrame:
    """Texts without weak parts, most of them and every empty one, meet nothing."""
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    weak, plain = scans.where(F.size("weak") > 0), scans.where(F.size("weak") == 0).withColumn("spans", F.col("base"))
    return weak.join(linked(scans), "__key", "left").withColumn("spans", every).drop("linked").select(*plain.columns).unionAll(plain)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts, overlapping ones merged, replaced by ``mark``; n_chars follows.

    Only the distinct texts with findings travel, under their digest; other rows stay as they are."""
    found = find(docs.where("text IS NOT NULL").select("text").withColumn("__digest", F.unhex(F.md5("text"))), ["__digest"])
    found = saved(found.where(F.size("spans") > 0).groupBy("__digest").agg(F.first("spans").alias("__spans")), "found")
    text = F.col("text")

    def step(acc, s):
        inside = s["start"] < acc["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate("__spans", start, step, lambda a: F.concat(F.concat_ws("", a["out"]), F.substring(text, a["at"] + 1, F.length(text))))
    rows = docs.withColumn("__digest", F.unhex(F.md5(F.coalesce("text", F.lit(""))))).join(found, "__digest", "left")
    hit = F.col("__spans").isNotNull() & text.isNotNull()
    rows = rows.withColumn("__new", F.when(hit, cut).otherwise(text))
    out = [F.col("__new").alias("text") if c == "text" else F.when(hit, F.length("__new")).otherwise(F.col(c)).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*out)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def twin() -> str:
    """The query in DuckDB: matches and gaps side by side, positions as running sums, links by distance."""
    found = " UNION ALL ".join(
        f"SELECT row, '{k}' AS p, unnest(regexp_extract_all(text, {_quoted(p)})) AS hit, unnest(list_transform(regexp_split_to_array(text, {_quoted(p)})[:-2], lambda x: length(x))) AS gap, "
        f"unnest(range(len(regexp_extract_all(text, {_quoted(p)})))) AS nr FROM d WHERE regexp_matches(text, {_quoted(p)})"
        for k, p in {"a": ASSIGN, "k": ACCESS, "h": HEX, "n": NAMED, "i": IDENTIFIER, "e": ENDPOINT}.items())
    value = f"length(regexp_extract(hit, {_quoted(ASSIGN)}, 2))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
p AS (SELECT row, p, hit, sum(gap + length(hit)) OVER (PARTITION BY row, p ORDER BY nr) AS stop FROM m),
q AS (SELECT row, hit, stop - length(hit) + CASE WHEN p IN ('n', 'i') AND NOT regexp_matches(hit, '^[A-Za-z]') THEN 1 ELSE 0 END AS start, stop, CASE
  WHEN p = 'a' AND {value} >= {LEAST_ASSIGN} THEN 0 WHEN p = 'a' AND {value} >= {LEAST_SHORT} THEN 3
  WHEN p = 'k' AND length(hit) >= {LEAST_ACCESS} THEN 1 WHEN p = 'h' THEN 2 WHEN p = 'n' THEN 4 WHEN p = 'i' THEN 5 WHEN p = 'e' THEN 6 END AS rank FROM p),
s AS (SELECT row, start, stop, rank, CASE WHEN rank IN (0, 3, 4) THEN 1 WHEN rank IN (1, 5, 6) THEN 2 END AS side,
  ['{"', '".join(KINDS)}'][rank::INT + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS one FROM q WHERE rank IS NOT NULL),
l AS (SELECT DISTINCT a.row, a.start, a.stop, a.rank, a.one FROM s a JOIN s b ON a.row = b.row AND a.side + b.side = 3
  AND a.start - b.stop <= {SCOPE} AND b.start - a.stop <= {SCOPE} AND (a.start >= b.stop OR b.start >= a.stop) WHERE a.rank >= 3),
b AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(one, ',' ORDER BY start, rank, stop) AS base FROM s WHERE rank < 3 GROUP BY row),
e AS (SELECT row, string_agg(one, ',' ORDER BY start, rank, stop) AS spans, count(*) FILTER (rank >= 3) AS n_linked
  FROM (SELECT row, start, stop, rank, one FROM s WHERE rank < 3 UNION ALL SELECT * FROM l) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN b USING (row) LEFT JOIN e USING (row)"""
