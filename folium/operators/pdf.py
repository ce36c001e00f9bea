"""Texts of PDF files behind a cache with three states: a text, a failure that is remembered, or nothing yet.

The key is the hash of the file. Extractors are slots: one gives the pages of a file, another, where no page is
worth keeping or the first fails, one text of the whole. What both fail at is not tried again unless asked for."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators import library

CACHE = "hash string, file_size long, previous_failure boolean, text string"
#: Bytes of a file to the texts of its pages, None of a page that cannot be read; or to one text.
Pages = Callable[[bytes], Iterable[str | None]]
Whole = Callable[[bytes], str]
#: A page or text counts from so many characters on, and the rule that stands for a page's end.
LEAST, RULE = 8, "-----"


def text_pages(content: bytes) -> list[str]:
    """A stand-in for an extractor: pages of a text that end with form feeds; what is no UTF-8 fails."""
    return content.decode().split("\f")


def no_text(content: bytes) -> str:
    raise ValueError("no other extractor")


def joined(pages: Iterable[str | None]) -> str | None:
    """The pages that are worth keeping as one text; None of none."""
    kept = [p for p in pages if p is not None and len(p) >= LEAST and p.strip() != RULE]
    text = "\n".join(kept).replace(f"{RULE}\n", "")
    return text if len(text.strip()) >= LEAST else None


def extracted_text(content: bytes, pages: Pages, whole: Whole) -> str | None:
    """The text of a file by one extractor or else the other; None if neither has one."""
    text = None
    try:
        text = joined(pages(content))
    except Exception:  # an extractor may fail in any way; the cache remembers it
        pass
    if text is None:
        try:
            text = whole(content).replace(f"{RULE}\n", "")
        except Exception:
            return None
    return text if text.strip() else None


def worklist(files: DataFrame, cache: DataFrame, retry: bool = False) -> DataFrame:
    """The files (hash and others) that are to be extracted, one for each content: those without an entry, those
    whose cached text is lost, and with retry those that failed before."""
    done = F.col("text").isNotNull() if retry else F.col("text").isNotNull() | F.col("previous_failure")
    one = files.dropDuplicates(["hash"])
    return library.missing(one, cache.where(done), "hash")


def extracted(files: DataFrame, pages: Pages, whole: Whole = no_text) -> DataFrame:
    """Cache entries of files (hash, file_size, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hash_, size, content in zip(batch["hash"], batch["file_size"], batch["content"]):
                text = extracted_text(content.as_py(), pages, whole)
                yield pa.RecordBatch.from_pydict({"hash": [hash_.as_py()], "file_size": pa.array([size.as_py()], pa.int64()), "previous_failure": [text is None], "text": pa.array([text], pa.string())})

    return files.select("hash", F.col("file_size").cast("long").alias("file_size"), "content").mapInArrow(run, CACHE)


def updated(files: DataFrame, cache: DataFrame, pages: Pages, whole: Whole = no_text, retry: bool = False, fetch: Callable[[DataFrame], DataFrame] = lambda files: files) -> DataFrame:
    """The cache after the texts of files (hash, file_size, and content or what fetch needs to read it) are looked for;
    fetch gets the worklist alone. New entries stand in place of those of the same content, also where a retry
    fails again. Each file is extracted once: what it takes the place of is known from the worklist."""
    todo = worklist(files, cache, retry)
    return library.missing(cache, todo, "hash").unionByName(extracted(fetch(todo), pages, whole))


def cleaned(cache: DataFrame, texts: DataFrame) -> DataFrame:
    """The cache without entries of contents (texts: hash) that the library does not have, and without those that
    say they have a text and have none."""
    return library.present(cache, texts, "hash").where("text is not null or previous_failure")
