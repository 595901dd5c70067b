"""The driver's tables seen as a store of files, chunks, memories, relations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import classify, text
from memloom.operators import chunk


class Corpus:
    """Lazily planned tables below one folder of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """``(doc_id, bank, path, source_type, lang, content)``: every document as a file of its source's bank."""
        ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".ts", ".json", ".txt")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
        kind = F.element_at(F.array(*[F.lit(x) for x in ("obsidian", "agent-sessions", "vault", "unknown")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
        docs = self.table("documents").withColumn("bank", F.coalesce("source", F.lit("none")))
        return docs.select(
            "doc_id", "bank", F.concat(F.lit("/"), "bank", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), kind.alias("source_type"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("content")
        )

    def lines(self) -> DataFrame:
        """The documents' line chunks, with their file, hash and memory ids."""
        rows = chunk.line_chunks(self.documents())
        rows = rows.withColumn("chunk_hash", text.chunk_hash(F.col("chunk")))
        return rows.withColumn("file_id", text.file_id(F.col("bank"), F.col("path"))).withColumn("memory_id", text.memory_id(F.col("bank"), F.col("chunk_hash")))

    def memories(self) -> DataFrame:
        """``(bank, memory_id, content, importance, scope)``: one row for each content of a bank; contents that repeat are episodic."""
        rows = self.lines().groupBy("bank", "memory_id").agg(F.first("chunk").alias("content"), F.count("*").alias("n"))
        return rows.select("bank", "memory_id", "content", F.lit(0.5).alias("importance"), F.when(F.col("n") > 1, "episodic").otherwise("working").alias("scope"))

    def file_chunks(self) -> DataFrame:
        """One row for each memory of a file, at its last place."""
        rows = self.lines().groupBy("file_id", "memory_id").agg(F.max("chunk_index").alias("chunk_index"), F.first("chunk_hash").alias("content_hash"))
        line = (F.col("chunk_index") + 1).alias
        unit = F.concat(F.lit("unit "), F.floor(F.col("chunk_index") / 3).cast("string"))
        return rows.select("file_id", "memory_id", "chunk_index", line("start_line"), line("end_line"), F.lit("").alias("section_header"), "content_hash", unit.alias("parent_unit_summary"))

    def files(self) -> DataFrame:
        role = classify.file_role(F.col("path"))
        return self.documents().select(
            text.file_id(F.col("bank"), F.col("path")).alias("id"), "doc_id", "bank", "path", "source_type", role.alias("file_role"), F.sha2("content", 256).alias("file_hash"), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("Summary of "), F.col("doc_id").cast("string"))).alias("summary"),
            text.keyword_tags(F.col("content")).alias("keywords"), F.array(F.concat(F.lit("lang-"), "lang"), F.col("bank")).alias("tags"), F.lit("indexed").alias("status"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("doc_id") * 7919, F.lit(1_000_003))).alias("created_at"), F.lit(0.5).alias("average_importance"),
        )

    def relations(self) -> DataFrame:
        """Siblings (the document numbered 20 more, if in the same bank), recommendations (twice the number), versions (the first file of equal content)."""
        docs = self.files().select("id", "doc_id", "bank", "file_hash")
        to = docs.select(F.col("id").alias("target_file_id"), F.col("doc_id").alias("to_id"), "bank")
        near = docs.withColumn("to_id", F.col("doc_id") + 20).join(to, ["to_id", "bank"]).select(F.col("id").alias("source_file_id"), "target_file_id", F.lit("sibling").alias("relation_type"), F.lit(0.5).alias("strength"))
        twice = docs.withColumn("to_id", F.col("doc_id") * 2).join(to, ["to_id", "bank"]).select(F.col("id").alias("source_file_id"), "target_file_id", F.lit("recommendation").alias("relation_type"), F.lit(0.7).alias("strength"))
        first = docs.groupBy("bank", "file_hash").agg(F.min_by("id", "doc_id").alias("target_file_id"))
        same = docs.join(first, ["bank", "file_hash"]).select(F.col("id").alias("source_file_id"), "target_file_id", F.lit("version").alias("relation_type"), F.lit(1.0).alias("strength"))
        every = near.unionByName(twice).unionByName(same).filter("source_file_id <> target_file_id")
        every = every.withColumn("id", text.relation_id(F.col("source_file_id"), F.col("target_file_id"), F.col("relation_type")))
        return every.withColumn("description", F.when(F.col("relation_type") != "sibling", F.concat(F.lit("by "), "relation_type")))

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files(), "file_chunks": self.file_chunks(), "file_relations": self.relations()}

    def remembered(self) -> DataFrame:
        """Line chunks as remembered rows; documents of a bank with one number // 40 are versions of one file, every seventh hash is unknown."""
        rows = chunk.line_chunks(self.documents().withColumn("file_hash", F.when(F.pmod("doc_id", F.lit(7)) != 0, F.sha2("content", 256))))
        k = F.floor(F.col("doc_id") / 40).cast("long")
        target = F.concat(F.lit("/"), "bank", F.lit("/"), (k + 1).cast("string"), F.lit(".md"))
        line = (F.col("chunk_index") + 1).cast("int").alias
        edge = F.struct(target.alias("target_path"), F.lit("sibling").alias("relation_type"), F.lit(0.5).alias("strength"), F.lit("next").alias("description"))
        chunk_hash = text.chunk_hash(F.col("chunk"))
        return rows.select(
            "bank", F.concat(F.lit("/"), "bank", F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), (F.col("doc_id") * 1000000 + F.col("chunk_index")).alias("seq"),
            text.memory_id(F.col("bank"), chunk_hash).alias("memory_id"), "chunk_index", line("start_line"), line("end_line"), F.lit(None).cast("string").alias("section_header"), chunk_hash.alias("chunk_hash"), "file_hash",
            "source_type", classify.file_role(F.col("path")).alias("file_role"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("summary"),
            F.create_map(F.lit("doc"), F.col("doc_id").cast("string")).alias("extra"), F.array(F.concat(F.lit("lang-"), "lang"), F.col("bank")).alias("tags"),
            F.struct(F.lit("u").alias("ref"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("summary")).alias("parent_unit"), F.array(edge).alias("edges"), F.col("chunk").alias("content"),
        )

    def notes(self) -> DataFrame:
        """``(root, path, doc_id, bank, content)``: the documents as Markdown notes with frontmatter and links to the documents numbered 20 more and less."""
        n = lambda x: (F.col("doc_id") + x).cast("string")
        kind = F.when(F.pmod("doc_id", F.lit(10)) == 0, "index").otherwise("note")
        content = F.concat(
            F.lit("---\ntype: "), kind, F.lit("\nstatus: "), "lang", F.lit("\ntags: ["), "bank", F.lit(", "), "lang", F.lit("]\nsee_also: "), (F.col("doc_id") * 2).cast("string"), F.lit("\n---\n"), "content",
            F.lit("\nSee [["), n(20), F.lit("|next]] and [["), n(-20), F.lit("#part]] ![[missing "), n(0), F.lit("]] [["), n(20), F.lit("]]"),
        )
        root = F.concat(F.lit("/"), F.col("bank"))
        return self.documents().select(root.alias("root"), F.concat(root, F.lit("/"), n(0), F.lit(".md")).alias("path"), "doc_id", "bank", content.alias("content"))

    def vault(self) -> tuple[DataFrame, DataFrame]:
        """Notes of a vault and its catalogue: files at the root, in folders, with dots and other extensions in their names, some names met twice.

        Each note links by every form: its own name, bare names, names with an extension, paths with and without one, names of nothing.
        """
        n = lambda x: F.pmod(F.col("doc_id") + x, F.lit(90)).cast("string")
        k, own = F.pmod("doc_id", F.lit(6)), F.pmod("doc_id", F.lit(90)).cast("string")
        folder = F.element_at(F.array(*[F.lit(x) for x in ("", "/sub", "/sub", "/deep/x", "/sub/y", "")]), (k + 1).cast("int"))
        ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".md", ".draft.md", ".md", ".png", ".draft.md")]), (k + 1).cast("int"))
        docs = self.documents().filter("doc_id is not null").withColumn("root", F.concat(F.lit("/v"), F.floor(F.col("doc_id") / 180).cast("string")))
        path = F.concat("root", folder, F.lit("/n"), own, ext)
        forms = [F.concat(F.lit("n"), own), F.concat(F.lit("n"), n(6)), F.concat(F.lit("n"), n(1)), F.concat(F.lit("n"), n(2)), F.concat(F.lit("n"), n(3)), F.concat(F.lit("n"), n(4), F.lit(".png")), F.concat(F.lit("sub/n"), n(1)), F.concat(F.lit("sub/n"), n(2), F.lit(".draft.md")), F.concat(F.lit("deep/x/n"), n(5), F.lit("|alias")), F.concat(F.lit("n"), n(7), F.lit(".draft")), F.lit("nothing here")]
        content = F.concat(F.lit("Links: "), F.concat_ws(" ", *[F.concat(F.lit("[["), f, F.lit("]]")) for f in forms]))
        notes = docs.groupBy("root", path.alias("path")).agg(F.min("doc_id").alias("doc_id"), F.min_by(content, "doc_id").alias("content"))
        return notes.filter("path like '%.md'"), notes.select("root", "path")

    def sessions(self) -> DataFrame:
        """``(path, content)``: each turn of a conversation as a file of its session."""
        names = F.array(*[F.lit(x) for x in ("session.md", "specifications/spec.md", "findings/findings.md", "decisions/decisions.md", "plans/implementation-plan.md")])
        name = F.when(F.col("turn") < 5, F.element_at(names, (F.col("turn") + 1).cast("int"))).otherwise(F.concat(F.lit("turns/turn-"), F.col("turn").cast("string"), F.lit(".md")))
        path = F.concat(F.lit("/sessions/"), F.col("conv_id").cast("string"), F.lit("/"), name)
        content = F.concat(F.coalesce("text", F.lit("")), F.lit(" see turns/turn-5.md and spec.md, or no-session.md"))
        return self.table("conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(path.alias("path"), content.alias("content"))

    def events(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts")
