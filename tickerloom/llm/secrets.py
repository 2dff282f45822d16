"""Secret scans with corpus-wide ownership: who holds a candidate, and how widely it is copied.

Spans come from SQL regular expressions: the parts between matches and the matches themselves
give their positions. Each candidate value is hashed. Places of a value with equal surroundings are
copies of one another and count for one owner, so that copying a text makes nothing an example; over
these, owners and repositories are counted in aggregates that combine map-side, so that neither a
common value nor a large owner meets in one task as rows. A value in `EXAMPLE_OWNERS` or more owners,
or in `EXAMPLE_REPOSITORIES` or more repositories of at least two owners, is a widely copied example;
any other that looks like a real credential is live; the rest is weak.
Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, let, prefix_sums, whole_text, written

# The patterns of the three kinds; group 1 is the value of an assignment.
ASSIGN = (
    r"""(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]+)"
#: kind, pattern, fewest characters of the value; in the order in which equal starts are listed.
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", "([0-9a-f]{24,})", 24))
#: Holds for every text that has a span.
_CANDIDATE = (
    r"""(?=[PpSsTtAa0-9b-f])(?:(?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]|(?=[A0-9a-f])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{24})"""
)
#: Distinct owners from which a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
#: Distinct repositories from which it does if two owners share them; one owner's are its own affair.
EXAMPLE_REPOSITORIES = 6
CLASSES = ("live", "example", "weak")
REDACTED = "[REDACTED]"


def looks_live(value: Column) -> Column:
    """Has digits and letters, eight or more different characters, and no placeholder word."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    placeholder = value.rlike("(?i)example|changeme|placeholder|your|dummy|sample|xxxx|test")
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~placeholder


def is_secret(value: Column, kind: str) -> Column:
    """What redaction takes for a credential: more than looks_live does, judged by the kind.

    Access keys and hex numbers have their full length, so eight different characters will do.
    Assigned values mix digits and letters, or are long; placeholder words count as whole parts.
    """
    different = F.size(F.array_distinct(F.split(value, "")))
    placeholder = value.rlike(
        "(?i)(?<![a-z])(?:example|changeme|placeholder|your|dummy|sample|x{4,}|test)(?![a-z])"
    )
    if kind != "assign":
        return (different >= 8) & ~placeholder
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 5)
    digits = value.rlike("^[0-9]{12,}$") & (different >= 5)
    return (mixed | digits | ((F.length(value) >= 16) & (different >= 8))) & ~placeholder


#: Characters on either side of a match that tell one place of a value from another.
SURROUNDINGS = 32
_FINDINGS = (
    "array<struct<start:bigint,order:int,end:bigint,kind:string,value_start:bigint,"
    "secret:string,lively:boolean,place:bigint,likely:boolean>>"
)


def _pieces(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Matches, their values, and the parts between them (one more)."""
    return (
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
        F.split(text, pattern, -1),
    )


def _found(text: Column, order: int) -> Column:
    kind, pattern, least = KINDS[order]

    def spans(zipped: Column) -> Column:
        steps = F.transform(zipped, lambda z: (F.length(z["gap"]) + F.length(z["match"])).cast("long"))
        with_start = F.zip_with(
            zipped,
            prefix_sums(steps),
            lambda z, before: F.struct(
                z["value"].alias("value"),
                (before + F.length(z["gap"])).alias("start"),
                (before + F.length(z["gap"]) + F.length(z["match"])).alias("end"),
                F.xxhash64(
                    F.right(z["gap"], F.lit(SURROUNDINGS)), F.left(z["after"], F.lit(SURROUNDINGS))
                ).alias("place"),
            ),
        )
        kept = F.filter(with_start, lambda s: F.length(s["value"]) >= least)
        return F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(order).alias("order"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                (s["end"] - F.length(s["value"])).alias("value_start"),
                F.sha2(s["value"], 256).alias("secret"),
                looks_live(s["value"]).alias("lively"),
                s["place"].alias("place"),
                is_secret(s["value"], kind).alias("likely"),
            ),
        )

    matches, values, gaps = _pieces(text, pattern)
    zipped = let(
        matches,
        lambda m: F.zip_with(
            m,
            F.arrays_zip(
                values.alias("value"),
                F.slice(gaps, F.lit(1), F.size(m)).alias("gap"),
                F.slice(gaps, F.lit(2), F.size(m)).alias("after"),
            ),
            lambda match, z: F.struct(
                match.alias("match"),
                z["value"].alias("value"),
                z["gap"].alias("gap"),
                z["after"].alias("after"),
            ),
        ),
    )
    return let(zipped, spans)


def findings(text: Column) -> Column:
    """The base spans of a text by start, then kind: an array of structs, empty for none."""
    all_kinds = F.array_sort(F.concat(*(_found(text, k) for k in range(len(KINDS)))))
    return F.when(text.rlike(_CANDIDATE), all_kinds).otherwise(F.array().cast(_FINDINGS))


def scan(docs: DataFrame, keep: list[str], owner: Column, repository: Column) -> DataFrame:
    """row, the kept columns, owner, repository and findings of each row of docs."""
    check_columns(docs, {"text", *keep})
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        *(F.col(f"`{c}`") for c in keep),
        owner.alias("owner"),
        repository.alias("repository"),
        findings(whole_text()).alias("findings"),
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """secret, n_owners, n_repositories, n_rows of each hashed value; a null owner is one owner.

    Places with equal surroundings are copies: all count for the smallest owner among them.
    """
    each = scanned.select("owner", "repository", F.explode("findings").alias("f"))
    places = each.groupBy(F.col("f.secret").alias("secret"), F.col("f.place").alias("place")).agg(
        F.min(F.struct("owner", "repository")).alias("first"), F.count("*").alias("n")
    )
    repositories = places.groupBy(
        "secret", F.col("first.owner").alias("owner"), F.col("first.repository").alias("repository")
    ).agg(F.sum("n").alias("n"))
    owners = repositories.groupBy("secret", "owner").agg(
        F.count("*").alias("repositories"), F.sum("n").alias("n")
    )
    return owners.groupBy("secret").agg(
        F.count("*").alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
        F.sum("n").alias("n_rows"),
    )


def classified(scanned: DataFrame, for_redaction: bool = False) -> DataFrame:
    """row, found: the classified values of each row that has any, with class and owners.

    For redaction is_secret says what is live.
    """
    known = ownership(scanned)
    live = F.col("f.likely") | F.col("f.lively") if for_redaction else F.col("f.lively")
    forked = (F.col("n_repositories") >= EXAMPLE_REPOSITORIES) & (F.col("n_owners") >= 2)
    wide = (F.col("n_owners") >= EXAMPLE_OWNERS) | forked
    each = scanned.select("row", F.explode("findings").alias("f")).withColumn("secret", F.col("f.secret"))
    group = (
        F.when(wide, "example")
        .when(live, "live")
        .otherwise("weak")
    )
    value = F.struct(
        F.col("f.value_start").alias("start"),
        F.col("f.end").alias("end"),
        group.alias("class"),
        "secret",
        "n_owners",
        "n_repositories",
    )
    return each.join(known, "secret").groupBy("row").agg(F.collect_set(value).alias("found"))


def report(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per row of docs: doc_id, findings (base spans) and found (classified values).

    A null text counts as empty and has neither; an empty table gives no rows. Repeated rows and
    copies are each reported and count as one owner. Texts of any length are read whole. Other
    columns of docs are ignored, whatever their names.
    """
    source = docs.select("doc_id", "text", owner.alias("__owner"), repository.alias("__repository"))
    scanned, _ = written(
        scan(source, ["doc_id"], F.col("__owner"), F.col("__repository")), "secrets"
    )
    tagged = scanned.join(classified(scanned), "row")
    none = scanned.where(F.size("findings") == 0)
    empty = F.array().cast(tagged.schema["found"].dataType)
    return tagged.select("doc_id", "findings", "found").unionByName(
        none.select("doc_id", "findings", empty.alias("found"))
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of an array of (start, order, end, kind) structs, sorted and joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        ),
        ",",
    )


def all_spans(found: Column, base: Column) -> Column:
    """The base spans and those of the classified values, whose kind is their class."""
    as_span = lambda start, order, end, kind: F.struct(
        start.alias("start"), order.alias("order"), end.alias("end"), kind.alias("kind")
    )
    added = F.transform(
        found,
        lambda v: as_span(
            v["start"],
            F.array_position(F.array(*map(F.lit, CLASSES)), v["class"]).cast("int") + len(KINDS),
            v["end"],
            v["class"],
        ),
    )
    plain = F.transform(base, lambda s: as_span(s["start"], s["order"], s["end"], s["kind"]))
    return F.concat(plain, F.array_distinct(added))


def _without(text: Column, order: int, live: Column) -> Column:
    """text with the live values of one kind replaced."""
    _, pattern, least = KINDS[order]
    matches, values, gaps = _pieces(text, pattern)
    shown = F.zip_with(
        matches,
        values,
        lambda m, v: F.when(
            (F.length(v) >= least) & F.array_contains(live, F.sha2(v, 256)),
            F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(v)), F.lit(REDACTED)),
        ).otherwise(m),
    )
    both = F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda g, s: F.concat(g, s))
    return F.array_join(both, "")


def redacted(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """docs with live values in text replaced; n_chars, where present, follows the new text.

    Widely copied examples and weak values stay; copies of one text make no example. Rows without live values, null texts included,
    are returned as they are. No row is dropped.
    """
    columns = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(columns)}
    source = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in inner.items()),
        F.col("text").alias("text"),
        owner.alias("__owner"),
        repository.alias("__repository"),
    )
    candidate = F.coalesce(F.col("text").cast("string").rlike(_CANDIDATE), F.lit(False))
    scanned, _ = written(
        scan(
            source.where(candidate),
            [*inner.values(), "text"],
            F.col("__owner"),
            F.col("__repository"),
        ),
        "secrets",
    )
    live = F.transform(F.filter("found", lambda v: v["class"] == "live"), lambda v: v["secret"])
    decided = classified(scanned, for_redaction=True).select("row", F.array_distinct(live).alias("live"))
    joined = scanned.join(decided, "row", "left")
    live = F.col("live")
    shown = _without(whole_text(), 0, live)
    shown = let(shown, lambda t: _without(t, 1, live))
    shown = let(shown, lambda t: _without(t, 2, live))
    joined = joined.withColumn("shown", F.when(F.size("live") > 0, shown).otherwise(F.col("text")))
    changed = {inner["text"]: F.col("shown")}
    if "n_chars" in inner:
        kind = docs.schema["n_chars"].dataType
        length = F.length("shown").cast(kind)
        changed[inner["n_chars"]] = F.when(F.size("live") > 0, length).otherwise(
            F.col(inner["n_chars"])
        )
    rows = joined.select(
        *(changed.get(n, F.col(n)).alias(c) for c, n in inner.items())
    )
    rest = source.where(~candidate).select(*(F.col(n).alias(c) for c, n in inner.items()))
    return rest.unionByName(rows)
