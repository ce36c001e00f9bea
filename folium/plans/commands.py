"""Command lines over a document library; every command gives a DataFrame."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import chronology, keys, text
from folium.operators import embedding, events, extraction, integrity, library, metadata, vectors
from folium.sources import assembly, snapshots


@dataclass(frozen=True)
class Settings:
    """What a command can override by name=value."""

    search_results: int = 8
    highlight: bool = True
    highlight_cutoff: float = 0.3
    highlight_dampening: float = 1.4
    context_length: int = 32
    context_steps: int = 16

    def with_(self, named: dict[str, str]) -> "Settings":
        """The settings with those of named that are settings; max_results stands for search_results."""
        kinds = {k: type(v) for k, v in self.__dict__.items()}
        given = {("search_results" if k == "max_results" else k): v for k, v in named.items()}
        cast = lambda kind, v: v.lower() in ("true", "1", "yes") if kind is bool else kind(v)
        return replace(self, **{k: cast(kinds[k], v) for k, v in given.items() if k in kinds})


@dataclass
class Desk:
    """A library's tables and the commands over them.

    texts (hash, source_name, descriptor, text), metadata (descriptor, title, authors, ...), chunks (model,
    doc, chunk_index, embedding; doc is a hash), timeline (jd_start, jd_end, context, eventdata, metadata).
    embed gives the vector of a query, extract the events of a text, embedders the vectors of chunks by model. files
    (hash, source_name, descriptor, text, ord) are what a sync takes in; root is the folder of the stored library,
    shared that of the published one."""

    texts: DataFrame
    metadata: DataFrame
    chunks: DataFrame
    timeline: DataFrame
    embed: Callable[[str], list[float]]
    model: str
    settings: Settings = field(default_factory=Settings)
    files: DataFrame | None = None
    root: str = ""
    shared: str = ""
    extract: extraction.Extractor = extraction.year_clauses
    disabled: set[str] = field(default_factory=set)
    embedders: dict[str, embedding.Embedder] = field(default_factory=dict)

    def run(self, line: str) -> DataFrame:
        """The command's result; ValueError for a line that is none."""
        name, _, rest = line.strip().partition(" ")
        command = getattr(self, f"do_{name}", None)
        if command is None:
            raise ValueError(f"no such command: {name}")
        return command(*keys.arguments(rest))

    def answer(self, request: str, given: dict[str, str] | None = None) -> DataFrame:
        """What a client asks for by the name of a request, with named values; ValueError for an unknown one."""
        given = given or {}
        at = lambda: self.texts.where(F.col("descriptor") == given["descriptor"])
        index = F.lit(int(given.get("chunk_index", 0)))
        requests: dict[str, Callable[[], DataFrame]] = {
            "test": lambda: self._done(True),
            "list_models": lambda: self.do_list(["models"], {}),
            "search": lambda: self.do_search(given["text"].split(), given),
            "select": lambda: self.do_select([given["model"]], {}),
            "get_3d_viz_data": lambda: self.do_index3d([], {}),
            "get_metadata": lambda: self.do_show([given["descriptor"]], {}),
            "get_vars": lambda: self.do_list(["vars"], {}),
            "set_var": lambda: self.do_set([], {given["name"]: given["value"]}),
            "get_text": lambda: self.do_open([given["descriptor"]], {}),
            "get_text_chunk": lambda: at().select(text.sentence_chunk(F.col("text"), index).alias("chunk")),
            "get_chunk_details": lambda: at().select(text.chunk_start(index).alias("start"), text.chunk_at(F.col("text"), index).alias("chunk"), text.chunk_count(F.col("text")).alias("chunks")),
            "timeline": lambda: self.do_timeline([], given),
        }
        if request not in requests:
            raise ValueError(f"no such request: {request}")
        return requests[request]()

    def do_list(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """list sources | models | vars | timeline"""
        what = plain[0] if plain else "sources"
        if what == "sources":
            return library.source_extensions(self.texts.select(F.col("source_name").alias("source"), text.extension(F.col("descriptor")).alias("ext")))
        if what == "models":
            return self.chunks.groupBy("model").agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("chunks"))
        if what == "vars":
            return self.texts.sparkSession.createDataFrame([(k, str(v), type(v).__name__) for k, v in self.settings.__dict__.items()], "name string, value string, type string")
        if what == "timeline":
            return self.timeline.agg(F.countDistinct("context").alias("tables"), F.count("*").alias("events"))
        raise ValueError(f"nothing to list: {what}")

    def do_set(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """set name=value ..."""
        self.settings = self.settings.with_(named)
        return self.do_list(["vars"], {})

    def do_select(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """select model"""
        self.model = plain[0]
        return self.do_list(["models"], {}).where(F.col("model") == self.model)

    def do_search(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """search words: rank, descriptor, cosine, chunk, marks; a disabled model finds nothing.

        The texts of the hits alone are read. marks: how far each character of the chunk answers the words, where
        highlight is set and the model can embed; else null."""
        settings, query = self.settings.with_(named), self.embed(" ".join(plain))
        chunks = self.chunks.where(F.col("model") == self.model)
        scores = vectors.scored(chunks.limit(0) if self.model in self.disabled else chunks, query)
        hits = vectors.ranked(vectors.best_chunks(scores), settings.search_results)
        chunk = text.clean_text(text.sentence_chunk(F.col("text"), F.col("chunk_index")))
        found = self.texts.withColumnRenamed("hash", "doc").join(hits, "doc").select("rank", "descriptor", "cosine", chunk.alias("chunk"))
        if settings.highlight and self.model in self.embedders:
            marked = vectors.highlighted(found.select(F.col("rank").alias("key"), F.col("chunk").alias("text"), "cosine"), query, self.embedders[self.model], settings.context_length, settings.context_steps, settings.highlight_cutoff, settings.highlight_dampening)
            found = found.join(marked.select(F.col("key").alias("rank"), "marks"), "rank")
        else:
            found = found.withColumn("marks", F.lit(None).cast("array<double>"))
        return found.select("rank", "descriptor", "cosine", "chunk", "marks").orderBy("rank")

    def do_ksearch(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """ksearch keys [source=name]"""
        return library.keyword_search(self.metadata, self.texts, " ".join(plain), named.get("source"))

    def do_show(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """show descriptor: its metadata"""
        return self.metadata.where(F.col("descriptor") == plain[0])

    def do_open(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """open descriptor: its text"""
        return self.texts.where(F.col("descriptor") == plain[0]).select("descriptor", "text")

    def do_timeline(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """timeline [time="a - b"] [domains="a !b"] [keywords="x|y"] [inside= covers= partial=]: date, event.

        A time that is none finds nothing; only events inside the time are found unless others are asked for."""
        found, on = self.timeline, lambda name, other: named.get(name, other).lower() == "true"
        if "time" in named:
            bounds = chronology.parse(F.lit(named["time"]))
            found = events.in_time(found.withColumn("_q", bounds), F.col("_q.jd_start"), F.col("_q.jd_end"), on("inside", "true"), on("covers", "false"), on("partial", "false"))
        found = events.search(found, domains=named["domains"].split() if "domains" in named else None, keys=named["keywords"].split() if "keywords" in named else None)
        date = chronology.interval_label(F.col("jd_start"), F.col("jd_end"))
        return events.by_time(found).select(date.alias("date"), events.event_text(F.col("eventdata")).alias("event")).where("date is not null")

    def do_check(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """check: models against the library"""
        return integrity.model_check(self.texts, self.chunks.withColumnRenamed("doc", "hash"))

    def do_index(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """index: makes and stores the vectors that enabled models lack; model, hash, descriptor, chunks of what it was.

        Without embedders it says what the model in use lacks."""
        held = self.chunks.withColumnRenamed("doc", "hash")
        enabled = {m: e for m, e in self.embedders.items() if m not in self.disabled}
        models = sorted(enabled) or [m for m in [self.model] if m not in self.disabled and not self.embedders]
        if not models:
            return self.texts.limit(0).select(F.lit("").alias("model"), "hash", "descriptor", F.lit(0).alias("chunks"))
        lacking = embedding.worklist(self.texts, held, models).select("model", "hash", "chunks")
        todo = lacking.join(self.texts.select("hash", "descriptor"), "hash").select("model", "hash", "descriptor", "chunks")
        if enabled:
            made = embedding.embedded(self.texts, held, enabled).withColumnRenamed("hash", "doc")
            done = self._stored({"indexed": todo, "chunks": self.chunks.unionByName(made)})
            todo, self.chunks = done["indexed"], done["chunks"]
        return todo

    def _stored(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Tables as a version of the stored library, or of a folder of this desk's own where it has none, read back."""
        spark = self.texts.sparkSession
        root = self.root or snapshots.work_folder(spark)
        number = snapshots.write(root, tables)
        return snapshots.read_all(spark, root, list(tables), number)

    def do_load(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """load [force=true]: the tables of the stored library, unless the shared one is newer"""
        spark = self.texts.sparkSession
        newer = bool(self.shared) and snapshots.version(spark, self.shared) > snapshots.version(spark, self.root)
        if newer and named.get("force", "false").lower() != "true":
            return self._done(False)
        held = snapshots.read_all(spark, self.root)
        self.texts, self.chunks = held.get("texts", self.texts), held.get("chunks", self.chunks)
        if "notes" in held:
            self.metadata = metadata.entries(held["notes"].withColumn("created", F.lit("")))
            context = F.get(F.filter("metadata", lambda m: m["k"] == "context"), F.lit(0))["v"]
            self.timeline = held["events"].withColumn("context", F.coalesce(context, "domain"))
        return self._done(bool(held))

    def do_timeline_extract(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """timeline_extract descriptor: the dated events that the extractor finds in its text"""
        text_of = self.texts.where(F.col("descriptor") == plain[0]).select(F.col("descriptor").alias("doc_id"), "text")
        return extraction.extracted(text_of, self.extract).select("date_text", "event_description")

    def do_index3d(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """index3d [folder=path]: the chunks of the model as points; written as JSON if a folder is given"""
        points = vectors.normalised_cloud(vectors.projected(self.chunks.where(F.col("model") == self.model)))
        if "folder" in named:
            points.write.mode("overwrite").json(f"{named['folder']}/{self.model}")
        return points

    def do_sync(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """sync: takes the sources' files into the library and stores it; what became of each file

        The metadata and the timeline follow from the notes among the files, of which changed ones alone are parsed."""
        actions = library.sync_actions(self.files, self.texts)
        if self.root:
            # both are stored before the library changes under them
            snapshots.write(self.root, {"texts": library.synced(self.files, self.texts), "sync_actions": actions})
            snapshots.sync_notes(self.texts.sparkSession, self.root, self.files.where(F.lower(text.extension(F.col("descriptor"))) == "md").select("descriptor", "hash", "text"))
            self.do_load([], {"force": "true"})
            actions = snapshots.read(self.texts.sparkSession, self.root, "sync_actions")
        return actions

    def do_enable(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """enable model: its vectors are made and searched"""
        self.disabled = self.disabled - set(plain)
        return self._enabled()

    def do_disable(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """disable model"""
        self.disabled = self.disabled | set(plain)
        return self._enabled()

    def _enabled(self) -> DataFrame:
        return self.do_list(["models"], {}).withColumn("enabled", ~F.col("model").isin(sorted(self.disabled)))

    def do_publish(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """publish: the stored library to the shared folder, if that is older"""
        return self._done(snapshots.publish(self.texts.sparkSession, self.root, self.shared))

    def do_import(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """import: the shared library, if it is newer than the stored one"""
        spark = self.texts.sparkSession
        done = snapshots.fetch(spark, self.shared, self.root)
        if done:
            self.do_load([], {"force": "true"})
        return self._done(done)

    def _done(self, done: bool) -> DataFrame:
        return self.texts.sparkSession.createDataFrame([(done,)], "done boolean")

    def do_export(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """export part: how many Markdown notes with it in their path a way to Org and back would change"""
        return assembly.export_check(self.texts.select(F.col("descriptor").alias("path"), "text"), plain[0] if plain else "")

    def do_clean(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        """clean: drops the vectors of texts that are gone, and stores what is left; how many for each model"""
        kept = library.present(self.chunks.withColumnRenamed("doc", "hash"), self.texts, "hash").withColumnRenamed("hash", "doc")
        self.chunks = self._stored({"chunks": kept})["chunks"]
        return self.do_list(["models"], {})

    def do_help(self, plain: list[str], named: dict[str, str]) -> DataFrame:
        rows = [(n.removeprefix("do_"), (getattr(type(self), n).__doc__ or "").split("\n")[0]) for n in sorted(dir(self)) if n.startswith("do_")]
        return self.texts.sparkSession.createDataFrame(rows, "command string, help string")
