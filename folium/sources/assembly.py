"""Notes put together from metadata and text, and plans of what an export writes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions import text as text_functions
from folium.operators import metadata
from folium.operators.library import reconcile
from folium.sources import datasource, snapshots
from folium.sources import notes as note_formats

#: Properties of times, which Org sets between brackets.
TIMES = ["pubdate", "publication_date", "creation", "creation_date"]


def _scalar(value: Column) -> Column:
    """A string as YAML: bare where it can be read back as the same string, else in quotes."""
    plain = value.rlike(r"^[\p{L}_][\p{L}\p{N}_ ./()+-]*$") & ~value.rlike(r"(?i)^(true|false|yes|no|on|off|null|y|n)$") & ~value.endswith(" ")
    return F.when(plain, value).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def with_front_matter(fields: dict[str, Column], lists: dict[str, Column], body: Column) -> Column:
    """A Markdown note: the fields and lists that are not empty in the order of their names, and the body. Without
    any field in the dictionaries the body alone."""
    if not fields and not lists:
        return body
    lines = {k: F.when(v != "", F.concat(F.lit(f"{k}: "), _scalar(v), F.lit("\n"))) for k, v in fields.items()}
    lines |= {k: F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:\n"), F.concat_ws("", F.transform(v, lambda x: F.concat(F.lit("- "), _scalar(x), F.lit("\n")))))) for k, v in lists.items()}
    return F.concat(F.lit("---\n"), F.concat_ws("", *[lines[k] for k in sorted(lines)]), F.lit("---\n"), body)


def with_drawer(prefix: Column, fields: dict[str, Column], lists: dict[str, Column], body: Column, order: list[str] | None = None, ready: dict[str, Column] | None = None) -> Column:
    """An Org note: prefix, a drawer of the fields and lists that are not empty in the order given (fields first
    without one), and the body. ready: values that stand as they are."""
    if not fields and not lists:
        return F.concat(prefix, body)
    quoted = lambda v: F.when(F.contains(v, F.lit(" ")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    around = lambda k, v: F.concat(F.lit(">"), quoted(v), F.lit("<")) if k in TIMES else F.concat(F.lit(" "), quoted(v))
    lines = {k: F.when(v != "", F.concat(F.lit(f":{k}:"), around(k, v), F.lit("\n"))) for k, v in fields.items()}
    lines |= {k: F.when(F.size(v) > 0, F.concat(F.lit(f":{k}:"), F.concat_ws("", F.transform(v, lambda x: F.concat(F.lit(" "), quoted(x)))), F.lit("\n"))) for k, v in lists.items()}
    lines |= {k: F.when(v != "", F.concat(F.lit(f":{k}: "), v, F.lit("\n"))) for k, v in (ready or {}).items()}
    return F.concat(prefix, F.lit(":PROPERTIES:\n"), F.concat_ws("", *[lines[k] for k in order or lines]), F.lit(":END:\n"), body)


def export_plan(notes: DataFrame, root: str, target: str, existing: DataFrame, to: str = "org") -> DataFrame:
    """path, target_path, refusal of notes (path, complete): an export writes a note to the same place below target,
    with the other ending, unless its metadata is incomplete, its path has the wrong ending or is not below root,
    or its target (path of existing) is there; refusal tells which, and is null of what is written."""
    ending, new = (".md", ".org") if to == "org" else (".org", ".md")
    root, target = root.rstrip("/"), target.rstrip("/")
    inside = F.substring(F.col("path"), len(root) + 1, 1 << 30)
    place = F.concat(F.lit(target), F.regexp_replace(inside, r"\.[a-z]+$", ""), F.lit(new))
    there = existing.select(F.col("path").alias("target_path"), F.lit(True).alias("_there")).distinct()
    planned = notes.withColumn("target_path", place).join(there, "target_path", "left")
    refusal = F.when(~F.col("complete"), "incomplete").when(~F.col("path").endswith(ending), "ending").when(~F.col("path").startswith(root + "/"), "outside").when(F.col("_there"), "exists")
    return planned.select("path", F.when(refusal.isNull(), F.col("target_path")).alias("target_path"), refusal.alias("refusal"))


def exported(notes: DataFrame, plan: DataFrame, to: str = "org") -> DataFrame:
    """target_path, text of the notes (path, text) that a plan does not refuse, in the other format."""
    wanted = plan.where("refusal is null").select("path", "target_path")
    rows = notes.join(wanted, "path").select(F.col("target_path").alias("note_id"), F.coalesce("text", F.lit("")).alias("text"))
    return note_formats.converted(rows, to).withColumnRenamed("note_id", "target_path")


def org_documents(notes: DataFrame) -> DataFrame:
    """path, text, complete of Markdown notes (path, descriptor, hash, created, text) as Org: the drawer from the front
    matter with all fields of the metadata, and the body converted."""
    keyed = notes.withColumn("note_id", F.col("path"))
    parts = note_formats.parsed_headers(keyed)
    bodies = note_formats.converted(parts.select("note_id", F.coalesce("body", F.lit("")).alias("text")), "org").withColumnRenamed("text", "_body")
    made = metadata.entries(keyed.join(parts.select("note_id", "header"), "note_id").select("note_id", "descriptor", "hash", "header", "created"))
    fields = {f: F.col(f) for f in metadata.FIELDS if f not in (*metadata.LISTS, "representations")}
    text = with_drawer(F.lit(""), fields, {f: F.col(f) for f in metadata.LISTS}, F.col("_body"), metadata.FIELDS, {"representations": metadata.representation_text(F.get("representations", F.lit(0)))})
    both = keyed.select("note_id", "descriptor").join(made, "descriptor").join(bodies, "note_id")
    return both.select(F.col("note_id").alias("path"), text.alias("text"), "complete")


def markdown_documents(notes: DataFrame) -> DataFrame:
    """path, text, complete of Org notes (path, text) as Markdown: front matter from the drawer, with what stood
    before the drawer in front of the converted body."""
    parts = note_formats.org_properties(notes.select(F.col("path").alias("note_id"), "text"))
    bodies = note_formats.converted(parts.select("note_id", F.col("body").alias("text")), "markdown").withColumnRenamed("text", "_body")
    given = lambda f: F.get_json_object("properties", f"$.{f}")
    plain = lambda v: F.regexp_replace(v, "^[<>](.*)[<>]$", "$1")
    none = F.array().cast("array<string>")
    lists = {f: F.when(given(f).startswith("["), F.coalesce(F.from_json(given(f), "array<string>"), none)).when(given(f) != "", F.array(given(f))).otherwise(none) for f in metadata.LISTS}
    fields = {f: F.coalesce(plain(given(f)), F.lit("")) for f in metadata.FIELDS if f not in (*metadata.LISTS, "representations")}
    text = with_front_matter(fields, lists, F.concat("prefix", "_body"))
    complete = given("uuid").isNotNull() & given("context").isNotNull()
    return parts.join(bodies, "note_id").select(F.col("note_id").alias("path"), text.alias("text"), complete.alias("complete"))


def _told(plan: DataFrame) -> DataFrame:
    """A plan as it is now, whatever becomes of the files that it was made of."""
    path = f"{snapshots.work_folder(plan.sparkSession)}/plan"
    plan.write.parquet(path)
    return plan.sparkSession.read.schema(plan.schema).parquet(path)


def export(notes: DataFrame, root: str, folder: str, target: str, to: str = "org") -> DataFrame:
    """Writes notes (path below root; for Org also descriptor, hash, created, and text) in the other format to the same
    places below the folder target of the store folder, all or none; path, target_path, refusal of each note.
    Files that are there stay as they are."""
    made = org_documents(notes) if to == "org" else markdown_documents(notes)
    there = datasource.load(notes.sparkSession, folder, "", ["org", "md"], ["descriptor"]).select(F.regexp_replace("descriptor", r"^\{\}", "").alias("path"))
    told = _told(export_plan(made.select("path", "complete"), root, target, there, to))  # before files that are there refuse themselves
    wanted = made.select("path", F.col("text").alias("content")).join(told.where("refusal is null").select("path", "target_path"), "path")
    datasource.save(wanted.select(F.col("target_path").alias("path"), "content"), folder)
    return told


def mirror(local: DataFrame, target: DataFrame, folder: str, dry: bool = False) -> DataFrame:
    """Makes the files below folder those of local: copies what is new, writes anew what differs in size or is newer,
    removes what is gone; rel_path, action of every file. local, target: rel_path, size, modified, local also path,
    which is read for files that are copied alone. dry: says what it would do."""
    actions = _told(reconcile(local, target))
    if not dry:
        copied = local.join(actions.where("action in ('copy', 'update')"), "rel_path", "left_semi").select("rel_path", "path")
        files = datasource.fetched(copied).select(F.col("rel_path").alias("path"), "content")
        gone = actions.where("action = 'delete'").select(F.col("rel_path").alias("path"), F.lit(None).cast("binary").alias("content"))
        datasource.save(files.unionByName(gone), folder, replace=True)
    return actions


def export_check(notes: DataFrame, part: str) -> DataFrame:
    """tested, failures: Markdown notes (path, text) with part in their path, and those that a way to Org and back
    changes."""
    chosen = notes.where(F.contains("path", F.lit(part)) & (F.lower(text_functions.extension(F.col("path"))) == "md"))
    same = note_formats.round_trips(chosen.select(F.col("path").alias("note_id"), "text"))
    return same.agg(F.count("*").alias("tested"), F.count_if(~F.col("same")).alias("failures"))
