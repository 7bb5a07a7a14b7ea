"""Documents of a workspace: deliveries, exact duplicates, listings, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_text

#: Confidence by source type; nothing is ever given level 1.
FILE_TYPES, LINKED_TYPES = ("pdf", "docx", "pptx", "markdown", "text"), ("web", "repository")


def latest(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """One row per ``key``: the last by ``newest``. Rows delivered twice count once; a null key is a key.

    The rows are reduced before they move, as a maximum over structs.
    """
    order = F.struct(*[F.col(c) for c in newest])
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__row")).select(key, "__row.*").select(*df.columns)


def source_type(c: Column | str) -> Column:
    """The type in its one spelling."""
    return F.lower(F.trim(c))


def confidence(c: Column) -> Column:
    """3 for files and text, 2 for what was fetched; null for an unknown type."""
    return F.when(source_type(c).isin(*FILE_TYPES), 3).when(source_type(c).isin(*LINKED_TYPES), 2)


def flag_duplicates(docs: DataFrame) -> DataFrame:
    """(id, project_id, content_hash, is_duplicate, first_id): exact duplicates within a project.

    Texts are compared normalised. Of equal ones the first to arrive (created_at, then id)
    is kept and the others flagged. Empty and null texts are no duplicates of each other.
    Only hashes are shuffled, and each key's first row is found with a partial minimum.
    """
    # The hash of an empty text stands for none, so a text is normalised once.
    h = docs.select("id", "project_id", "created_at", F.nullif(content_hash("raw_text"), F.sha2(F.lit(""), 256)).alias("content_hash"))
    first = h.where("content_hash IS NOT NULL").groupBy("project_id", "content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("first_id"))
    h, first = h.alias("h"), first.alias("first")
    same = F.col("h.project_id").eqNullSafe(F.col("first.project_id")) & (F.col("h.content_hash") == F.col("first.content_hash"))
    out = h.join(first, same, "left").select("h.id", "h.project_id", "h.content_hash", "first_id")
    return out.select("id", "project_id", "content_hash", F.coalesce(F.col("first_id") != F.col("id"), F.lit(False)).alias("is_duplicate"), "first_id")


def summaries(docs: DataFrame) -> DataFrame:
    """The listing of documents: without their text but with its length, and a status where there is none."""
    status = F.coalesce("processing_status", F.lit("ready"))
    return docs.select(
        "id",
        "project_id",
        source_type("source_type").alias("source_type"),
        "title",
        F.coalesce(F.length("raw_text"), F.lit(0)).cast("long").alias("char_count"),
        "confidence_level",
        status.alias("processing_status"),
        (status == "duplicate").alias("is_duplicate"),
        "summary",
        "created_at",
    )


def with_project(docs: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents with their project's name; those of no project are left out."""
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return docs.join(names, "project_id")


def effective_type(kind: Column, title: Column, url: Column) -> Column:
    """A web page of a code host counts as a repository."""
    host = F.coalesce(F.contains(F.lower(title), F.lit("github")), F.lit(False)) | F.coalesce(F.contains(F.lower(url), F.lit("github")), F.lit(False))
    return F.when((source_type(kind) == "web") & host, "repository").otherwise(source_type(kind))


def status_label(status: Column) -> Column:
    """What a status is called."""
    labels = {"parsing": "Parsing", "chunking": "Chunking", "embedding": "Embedding", "ready": "Ready", "failed": "Failed", "duplicate": "Duplicate", "pending": "Pending"}
    out = F.when(F.lit(False), "")
    for key, label in labels.items():
        out = out.when(F.lower(F.trim(status)) == key, label)
    return out.otherwise("In Queue")


def icon(title: Column, kind: Column, url: Column) -> Column:
    """A document's icon class by its name's ending, else by where it came from."""
    name = F.lower(title)
    out = F.when(F.lit(False), "")
    for suffixes, value in ((("pdf",), "pdf"), (("docx", "doc"), "word"), (("pptx", "ppt"), "slides"), (("md", "txt"), "text")):
        out = out.when(name.rlike(rf"\.(?:{'|'.join(suffixes)})$"), value)
    kinds = F.create_map(*[F.lit(x) for pair in (("pdf", "pdf"), ("docx", "word"), ("pptx", "slides"), ("markdown", "text"), ("text", "text")) for x in pair])
    return F.coalesce(out, F.when(effective_type(kind, title, url) == "repository", "repository"), F.try_element_at(kinds, source_type(kind)), F.lit("web"))


def host(url: Column) -> Column:
    """The host of an address without ``www.``; null where it is none."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def bare_url(url: Column) -> Column:
    """An address without scheme and ``www.``."""
    return F.regexp_replace(url, r"^(?:https?://)?(?:www\.)?", "")


def find(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    """Documents with ``text`` in any of ``columns``, whatever the case; all for an empty one. Nulls don't match."""
    needle = text.strip().lower()
    hit = F.lit(not needle)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return docs.where(hit)


class NotFound(LookupError):
    """A row that was asked for by its id isn't there."""


class Conflict(ValueError):
    """A name that must be unique is taken."""


def existing(df: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, found): which of ``keys`` (id) are rows of ``df``."""
    held = df.select("id").distinct().withColumn("__hit", F.lit(True))
    return keys.select("id").distinct().join(held, "id", "left").select("id", F.coalesce("__hit", F.lit(False)).alias("found"))


def require(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """The row ``key`` of ``df``; :class:`NotFound` if there is none. A point lookup that stops at the first hit."""
    rows = df.where(F.col("id") == key)
    if rows.isEmpty():
        raise NotFound(f"no {name} {key!r}")
    return rows


_HOST = r"[\w-]+(?:\.[\w-]+)+"


def not_yet_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """New (title, source_url) whose title no ``known`` document has, and whose address without scheme and ``www.`` is no known one's and in no known title.

    While a page is read its address is its title. Titles and addresses meet by the hosts
    that they name, so no title is compared with all addresses; an address without a host is new.
    """
    by_title = new.join(known.select("title").where("title IS NOT NULL").distinct(), "title", "left_anti")
    labels = lambda c: F.split(F.regexp_extract(c, f"^({_HOST})", 1), r"\.")
    # A title's host also stands for what is left when leading labels are taken off.
    hosts = F.flatten(F.transform(F.regexp_extract_all("title", F.lit(f"({_HOST})"), F.lit(1)), lambda h: F.transform(F.sequence(F.lit(1), F.size(labels(h))), lambda i: F.array_join(F.slice(labels(h), i, 99), "."))))
    titles = known.where("title IS NOT NULL").select(F.col("title").alias("__in"), F.explode(F.array_distinct(hosts)).alias("__host")).distinct()
    asked = by_title.withColumn("__bare", bare_url(F.col("source_url"))).withColumn("__host", F.regexp_extract("__bare", f"^({_HOST})", 1))
    urls = known.select(bare_url(F.col("source_url")).alias("__bare")).where("__bare IS NOT NULL").distinct()
    a, t = asked.join(urls, "__bare", "left_anti").alias("a"), titles.alias("t")
    return a.join(t, (F.col("a.__host") == F.col("t.__host")) & F.contains(F.col("t.__in"), F.col("a.__bare")), "left_anti").drop("__bare", "__host")


def retitled(docs: DataFrame, parsed_title: str = "parsed_title") -> DataFrame:
    """A page's own title in place of its address, while the title still is the address."""
    use = (F.col("title") == F.col("source_url")) & F.col(parsed_title).isNotNull()
    return docs.withColumn("title", F.when(use, F.col(parsed_title)).otherwise(F.col("title"))).drop(parsed_title)


def renamed(df: DataFrame, key: str, name: str, column: str = "title", most: int = 100) -> DataFrame:
    """``column`` of the row ``key`` set to the stripped ``name``, of at most ``most`` characters; an empty name changes nothing."""
    value = name.strip()[:most]
    return df.withColumn(column, F.when((F.col("id") == key) & F.lit(bool(value)), F.lit(value)).otherwise(F.col(column)))


def touched(df: DataFrame, keys: DataFrame, now: Column, column: str = "updated_at") -> DataFrame:
    """``column`` set to ``now`` for the ids in ``keys`` (id)."""
    mark = keys.select("id").distinct().withColumn("__hit", F.lit(True))
    return df.join(mark, "id", "left").withColumn(column, F.when(F.col("__hit"), now).otherwise(F.col(column))).select(*df.columns)


def conflicts(projects: DataFrame, new: DataFrame) -> DataFrame:
    """(id, name, conflict): which of ``new`` (id, name) have a name that is taken."""
    taken = projects.select("name").distinct().withColumn("__hit", F.lit(True))
    return new.select("id", "name").join(taken, "name", "left").select("id", "name", F.coalesce("__hit", F.lit(False)).alias("conflict"))


def created(projects: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """``projects`` and those of ``new`` whose name is free; a taken name is left out, or a :class:`Conflict` if ``strict``."""
    if strict and not (taken := conflicts(projects, new).where("conflict")).isEmpty():
        raise Conflict(f"there is a project {taken.first().name!r}")
    free = new.join(projects.select("name"), "name", "left_anti").select(*projects.columns)
    return projects.unionByName(free)


#: Which column of a child table names its parent.
CHILDREN = {
    "projects": (("project_documents", "project_id"), ("chunks", "project_id"), ("sessions", "project_id")),
    "project_documents": (("chunks", "doc_id"),),
    "chunks": (("chunk_embeddings", "chunk_id"),),
    "sessions": (("session_messages", "session_id"),),
}


def delete(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the rows ``keys`` (id) of ``name`` and without all that hangs on them."""
    out = dict(tables)
    gone = out[name].join(keys.select("id").distinct(), "id", "left_semi").select("id").distinct()
    out[name] = out[name].join(gone, "id", "left_anti").select(*out[name].columns)
    for child, column in CHILDREN.get(name, ()):
        if child in out:
            hit = out[child].join(gone.select(F.col("id").alias(column)), column, "left_semi").select("id")
            out = delete(out, child, hit)
    return out
