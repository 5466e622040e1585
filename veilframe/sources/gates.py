"""Sources, the ordered gates a document passes before it is read, and the names and writers of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Caps, checked on construction: all at least 1, the free page cap not above the paid one."""

    free_pages: int = 3
    most_pages: int = 50
    most_bytes: int = 26_214_400
    context: int = 40
    most_terms: int = 50
    most_term_chars: int = 100

    def __post_init__(self):
        if min(self.free_pages, self.most_pages, self.most_bytes, self.most_terms, self.most_term_chars) < 1 or not 0 <= self.context <= 200:
            raise ValueError("limits out of range")
        if self.free_pages > self.most_pages or self.most_terms > 100 or self.most_term_chars > 200:
            raise ValueError("limits contradict each other")

    @classmethod
    def from_env(cls, env: dict[str, str]) -> Limits:
        """From whole numbers in strings; absent ones keep their default, anything else is refused."""
        names = {"free_pages": "FREE_PAGE_CAP", "most_pages": "MAX_PAGES", "most_bytes": "MAX_FILE_BYTES", "context": "CONTEXT_CHARS", "most_terms": "MAX_TERMS", "most_term_chars": "MAX_TERM_CHARS"}
        given = {}
        for field, name in names.items():
            if (value := env.get(name, "").strip()) != "":
                if not value.isascii() or not value.isdigit():
                    raise ValueError(f"{name} must be a whole number")
                given[field] = int(value)
        return cls(**given)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly where a table has fewer splits than the cluster has cores: reading texts takes the processor, not the disk. A larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly whatever files they come from, for rows that are small before they become texts: a row group is never split, so a table of many splits may still lie in a few of them."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def pdf_header(content: Column) -> Column:
    """Does the header stand whole in the first 1024 bytes of a file?"""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def files_at_the_door(files: DataFrame, limits: Limits) -> DataFrame:
    """binaryFile rows with refusal: size first, then the header."""
    return files.withColumn("refusal", F.when(F.col("length") > limits.most_bytes, "too-large").when(~pdf_header(F.col("content")), "not-pdf"))


UNREADABLE = "[\\s\\p{Cc}\\p{Co}\\p{Cs}\\x{FFFD}]"


def refusal(text: Column, pages: Column, limits: Limits) -> Column:
    """Why a text document is not opened; the first gate that fails says."""
    return (
        F.when(F.octet_length(text) > limits.most_bytes, "too-large")
        .when(text.isNull(), "corrupt")
        .when(pages > limits.most_pages, "too-many-pages")
        .when(F.length(F.regexp_replace(text, UNREADABLE, "")) == 0, "no-readable-text")
    )


#: The gates in order, and what a document is refused as at each; a gate is a column that says that the document fails it.
GATES = {
    "too_large": "too-large", "no_header": "not-pdf", "damaged": "corrupt", "locked": "password-required", "many_pages": "too-many-pages", "layered": "hidden-layers", "unreadable": "no-readable-text", "empty_clip": "unsupported", "odd_structure": "unreadable-structure",
}


def first_refusal(**fails: Column) -> Column:
    """Why a document is not opened: the first of GATES that it fails, whatever order they are given in; null where it fails none. What can't be told (null) is no failure."""
    if unknown := set(fails) - set(GATES):
        raise ValueError(f"no such gates: {sorted(unknown)}")
    return F.coalesce(*(F.when(fails[g], name) for g, name in GATES.items() if g in fails))


def output_name(name: Column, form: Column) -> Column:
    """name trimmed, without .pdf, 'document' when nothing is left, with the form's ending."""
    stem = F.regexp_replace(F.trim(name), "(?i)\\.pdf$", "")
    return F.concat(F.when(F.length(F.trim(stem)) == 0, "document").otherwise(stem), F.lit("-"), form, F.lit(".pdf"))


def output_form(n_removed: Column, partly: Column) -> Column:
    return F.when(n_removed == 0, "cleaned").when(partly, "partly-redacted").otherwise("redacted")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
