"""Secret scans by corpus-wide ownership of candidate values, in DataFrame operations only.

A scan finds spans of fixed kinds in each text and, besides, values that may be credentials: those of
authorisation headers, passwords in addresses, bodies of private keys and long mixed strings. Each candidate
value is hashed, and the distinct repositories and owners of a hash are counted over the whole corpus: a value
that many owners or very many repositories hold is a widely copied example, another looks live. Candidates
beyond the fixed kinds are added to the spans if they look live.

Positions come from splitting a text at a pattern: the pieces between matches, and the matches, have
lengths that sum up to code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# Fixed patterns: name, regular expression, group of the value, least length of the value.
_KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
KINDS = (
    ("assign", _KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]+)", 1, 32),
)
#: The kinds that the method adds. The last, any long run, must be varied and apart from all others.
ADDED = (
    ("bearer", "(?:[Bb]earer|[Bb]asic)\\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    ("url", "[a-z][a-z0-9+.-]*://[^\\x20\\x09-\\x0D/:@]+:([^\\x20\\x09-\\x0D/:@]+)@", 1, 4),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\\x20\\x09-\\x0D]+)-----END", 1, 32),
    ("key", "([A-Za-z0-9+/_=-]+)", 1, 20),
)
#: Characters of a match behind its value.
TAILS = {"url": 1, "pem": 8}
#: Patterns without which a text has no match that counts; they are faster to rule out.
QUICK = {
    "assign": None, "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "bearer": "(?:earer|asic)\\x20+[A-Za-z0-9._~+/=-]{16}",
    "url": "://[^\\x20\\x09-\\x0D/:@]+:[^\\x20\\x09-\\x0D/:@]{4,}@", "pem": "PRIVATE KEY-----", "key": "[A-Za-z0-9+/_=-]{20}",
}
#: A value of more owners, or of more repositories, than this is taken for an example.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 100
#: Rows of one value are spread over so many tasks.
SPREAD = 64

_SPAN = "array<struct<start:long,rank:int,kind:string,end:long,stop:long,value:string>>"
_PLAIN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose value is long enough, as structs in order of start. ``stop``:
    where the value ends."""
    lit = _literal(pattern)
    steps = f"arrays_zip(split({text}, {lit}, -1), regexp_extract_all({text}, {lit}, 0), regexp_extract_all({text}, {lit}, {group}))"
    end = "a.at + x.gap + x.size"
    walk = f"""aggregate(
        filter(transform({steps}, x -> struct(char_length(x['0']) AS gap, char_length(x['1']) AS size, x['2'] AS value)), x -> x.size IS NOT NULL),
        struct(cast(0 AS long) AS at, cast(array() AS {_SPAN}) AS spans),
        (a, x) -> struct({end} AS at,
            if(char_length(x.value) >= {least},
               cast(array_append(a.spans, struct(a.at + x.gap AS start, {rank} AS rank, '{kind}' AS kind, {end} AS end, {end} - {TAILS.get(kind, 0)} AS stop, x.value AS value)) AS {_SPAN}),
               a.spans) AS spans),
        a -> a.spans)"""
    return F.expr(f"CASE WHEN {text} RLIKE {_literal(QUICK[kind] or pattern)} THEN {walk} ELSE cast(array() AS {_SPAN}) END")


def _joined(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds to a table with ``text`` the spans of each fixed kind, s_<kind>, and ``found``: all candidates,
    each with the hash of its value."""
    df = df.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    for i, (kind, pattern, group, least) in enumerate((*KINDS, *ADDED)):
        df = df.withColumn(f"s_{kind}", _spans("t", i, kind, pattern, group, least))
    apart = lambda spans, others: f"filter({spans}, x -> NOT exists({others}, b -> b.start < x.end AND x.start < b.end))"
    varied = "filter(s_key, x -> x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]' AND size(array_distinct(split(x.value, ''))) >= 10)"
    df = df.withColumn("base", F.expr(f"concat({', '.join('s_' + k[0] for k in KINDS)})"))
    df = df.withColumn("known", F.expr(f"concat(base, {apart('concat(' + ', '.join('s_' + k[0] for k in ADDED[:-1]) + ')', 'base')})"))
    df = df.withColumn("found", F.expr(f"concat(known, {apart(varied, 'known')})"))
    return df.withColumn("found", F.expr("transform(found, x -> struct(x.start, x.rank, x.kind, x.end, x.stop, char_length(x.value) AS size, md5(x.value) AS hash))"))


def _judged(rows: DataFrame, live_owners: int, live_repositories: int) -> DataFrame:
    """(row, start, rank, kind, end, stop, size, owners, repositories, live) of each candidate in a table (row,
    repository, owner, found).

    Each distinct (hash, owner, repository) comes first, and verdicts are joined to groups of a value's rows,
    so that no task meets all rows of a value.
    """
    held = rows.where("size(found) > 0").select("row", "repository", "owner", F.explode("found").alias("s")).select("row", "repository", "owner", "s.*")
    held = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SPREAD)))
    by_owner = held.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    owned = owned.withColumn("live", (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories))
    dealt = held.select("hash", "salt").distinct().join(owned, "hash")
    return held.drop("repository", "owner").join(dealt, ["hash", "salt"])


def scan(documents: DataFrame, repository: str = "doc_id", owner: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, counts and digest of the base kinds, all spans, and how many of the
    candidate values look live or are examples.

    A null or empty text has no spans. Rows that repeat an id get a row each. A null owner counts as an
    owner of its own, the same for all such rows, and a null repository likewise. Further columns are
    not read. All counts cover all documents.
    """
    scratch = Scratch(documents.sparkSession, "secrets")
    read = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    rows = scratch.save(_with_candidates(read).select("row", "doc_id", "repository", "owner", *(F.expr(f"cast(size(s_{k[0]}) AS long)").alias(f"n_{k[0]}") for k in KINDS), "found"))
    judged = (
        _judged(rows, live_owners, live_repositories)
        .groupBy("row")
        .agg(
            F.collect_list(F.when((F.col("rank") < len(KINDS)) | F.col("live"), F.struct("start", "rank", "kind", "end"))).alias("kept"),
            F.count(F.when(F.col("live"), 1)).alias("n_live"),
            F.count(F.when(~F.col("live"), 1)).alias("n_example"),
            F.max("owners").alias("most_owners"),
            F.max("repositories").alias("most_repositories"),
        )
    )
    base = f"filter(kept, x -> x.rank < {len(KINDS)})"
    return (
        rows.join(judged, "row", "left")
        .withColumn("kept", F.expr(f"coalesce(kept, cast(array() AS {_PLAIN}))"))
        .select(
            "doc_id", *(f"n_{k[0]}" for k in KINDS),
            F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"),
            F.expr(_joined("kept")).alias("spans"),
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")),
        )
    )


def mask_live(documents: DataFrame, owner: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """The documents with each live-looking value overwritten by as many asterisks.

    Widely copied values are examples and stay. All rows and columns are kept, under any names; null texts
    stay null. A document's id counts as its repository; null ids and owners count as in ``scan``, and rows
    that repeat an id are masked one by one. Only rows with candidates are shuffled.
    """
    scratch = Scratch(documents.sparkSession, "secret-masks")
    read = documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*documents.columns).alias("doc"), "text", F.col("doc_id").cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    rows = scratch.save(_with_candidates(read).select("row", "doc", "repository", "owner", "found"))
    live = _judged(rows.select("row", "repository", "owner", "found"), live_owners, live_repositories).where("live")
    masks = live.groupBy("row").agg(F.collect_list(F.struct("stop", "size")).alias("masks"))
    masked = F.expr("aggregate(masks, doc.text, (t, m) -> overlay(t, repeat('*', m.size), cast(m.stop - m.size + 1 AS int), m.size))")
    text = F.when(F.col("masks").isNull(), F.col("doc.text")).otherwise(masked)
    found = rows.where("size(found) > 0").join(masks, "row", "left").select(text.alias("masked"), "doc")
    clean = rows.where("size(found) = 0").select(F.col("doc.text").alias("masked"), "doc")
    return clean.unionByName(found).select(*(F.col("masked").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in documents.columns))
