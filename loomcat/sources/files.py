"""Files and texts as rows: listing, kinds, hashes, chunks and stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import let

#: Leading bytes (hex) of file formats, by kind.
MAGIC = {
    "pdf": ("25504446",),
    "image": ("89504e47", "ffd8ff", "47494638", "424d", "49492a00", "4d4d002a"),
    "audio": ("494433", "fffb", "fff3", "664c6143", "4f676753"),
    "video": ("1a45dfa3", "000001ba", "000001b3"),
}
#: Folders inside a zip file that tell office documents apart.
OFFICE = {"word": "word/", "excel": "xl/", "powerpoint": "ppt/"}
TEXT_KINDS = ("text", "txt", "pdf", "json", "word", "excel", "powerpoint")
HEAD = 4096


def listed(spark: SparkSession, folder: str, *, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files under a folder; empty files have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def kind(content: Column) -> Column:
    """The file kind by leading bytes; unknown where nothing tells."""
    head = F.substring(content, 1, HEAD)
    code, plain = F.lower(F.hex(head)), F.decode(head, "ISO-8859-1")
    out = F.lit(None).cast("string")
    for name, marks in MAGIC.items():
        for mark in marks:
            out = F.coalesce(out, F.when(code.startswith(mark), name))
    box = F.substring(plain, 5, 4) == "ftyp"
    riff = F.substring(plain, 9, 4)
    out = F.coalesce(out, F.when(box, "video"), F.when(code.startswith("52494646"), F.when(riff == "WAVE", "audio").when(riff == "AVI ", "video").when(riff == "WEBP", "image")))
    for name, inside in OFFICE.items():
        # the folders stand in the archive's directory, at its end
        out = F.coalesce(out, F.when(code.startswith("504b0304") & F.contains(content, F.lit(bytearray(inside.encode()))), name))
    shut = ~plain.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]") & (F.length(content) > 0)
    return F.coalesce(out, F.when(shut & plain.rlike(r"(?s)^\s*[\[{].*[\]}\",0-9a-z]\s*$"), "json"), F.when(shut, "text"), F.lit("unknown"))


def modality(kind: Column) -> Column:
    """text, image, video, audio or unknown."""
    return F.when(kind.isin(*TEXT_KINDS), "text").when(kind.isin("image", "video", "audio"), kind).otherwise("unknown")


def hashed(files: DataFrame) -> DataFrame:
    """files with file_hash (SHA-256) and file_size in place of their content."""
    return files.withColumns({"file_hash": F.sha2("content", 256), "file_size": F.length("content").cast("long")}).drop("content")


def first_of_hash(rows: DataFrame, hash: str, key: str) -> DataFrame:
    """The smallest key of each hash; rows without a hash stay. Only keys and hashes are grouped."""
    first = rows.where(F.col(hash).isNotNull()).groupBy(hash).agg(F.min(key).alias(key))
    return first.select(key).unionByName(rows.where(F.col(hash).isNull()).select(key))


def parsed_vector(text: Column) -> Column:
    """A vector from text such as [1,2.5]; null if it is none."""
    return F.from_json(F.trim(text), "array<float>")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def packed(segments: Column, size: int) -> Column:
    """Chunks of at most size characters: segments joined by line ends while they fit, longer ones cut."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, s: Column) -> Column:
        closed = F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        fits = (a["open"] != "") & (F.char_length(a["open"]) + 1 + F.char_length(s) <= size)
        state = lambda buf, out: F.struct(buf.alias("open"), out.alias("done"))
        return (
            F.when(F.coalesce(s, F.lit("")) == "", a)
            .when(F.char_length(s) > size, state(F.lit(""), F.concat(closed, _pieces(s, size))))
            .when(fits, state(F.concat(a["open"], F.lit("\n"), s), a["done"]))
            .otherwise(state(s, closed))
        )

    return F.aggregate(F.transform(segments, _stripped), start, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def overlapped(chunks: Column, overlap: int) -> Column:
    """Each chunk behind the end of the one before it."""
    if overlap <= 0:
        return chunks
    end = lambda x: F.substring(x, F.greatest(F.char_length(x) - overlap, F.lit(0)) + 1, F.lit(overlap))
    behind = lambda every: F.transform(every, lambda c, i: F.when(i == 0, c).otherwise(_stripped(F.concat(end(F.get(every, i - 1)), F.lit("\n"), c))))
    return let(chunks, behind)


def chunks(text: Column, size: int, *, overlap: int = 0, most: int | None = None) -> Column:
    """Chunks of a plain text, which is one segment (of at most `most` characters, if that is given); none for a blank one."""
    if overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be at least 0 and less than the chunk size")
    whole = F.coalesce(text, F.lit(""))
    return overlapped(packed(F.array(whole if most is None else F.substring(whole, 1, max(most, 0))), size), overlap)
