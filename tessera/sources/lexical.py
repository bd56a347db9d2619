"""The stored lexical index: chunks and their postings in blocks, written once, read by every ranking, updated group by group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import if_small, written
from tessera.operators.retrieval import tokens
from tessera.sources import grouped

#: Chunks of a block, on average, and blocks of a group: the unit that an update writes anew.
BLOCK_CHUNKS, GROUP_BLOCKS = 2048, 32
#: Blocks that one task of a build has, about.
PARTITION_BLOCKS = 16
#: Neighbouring chunks of a document that lie in one block.
TOGETHER = 256


@dataclass(frozen=True)
class LexicalIndex:
    """chunks: group, block, place (from 0 within the block, by chunk_id), length (in words) and what the source has: chunk_id, doc_id, chunk_index, content and others.

    postings: group, block, term, n (chunks with it), most (the greatest frequency among them), least (the smallest length), places, tfs, lengths (arrays, by place)."""

    folder: str
    blocks: int
    chunks: DataFrame
    postings: DataFrame

    def located(self, rows: DataFrame, doc_id: str = "doc_id", chunk_index: str = "chunk_index") -> DataFrame:
        """rows with the group and block of the chunks that they name."""
        return _located(rows, F.col(doc_id), F.col(chunk_index), self.blocks)

    def chunks_at(self, located: DataFrame) -> DataFrame:
        """The chunks of the groups of located() rows: other groups' files aren't read."""
        return self.chunks.filter(F.col("group").isin([r["group"] for r in located.select("group").distinct().collect()]))  # at most the groups of the manifest


def _located(rows: DataFrame, doc_id: Column, chunk_index: Column, blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64(doc_id.cast("string"), F.floor(chunk_index / TOGETHER).cast("long")), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS).cast("int"))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (group, block, others) with each block in one partition, few blocks in each: what is grouped by block and more needs no other shuffle."""
    return rows.repartitionByRange(max(rows.sparkSession.sparkContext.defaultParallelism, -(-blocks // PARTITION_BLOCKS)), "group", "block")


#: Columns of the postings.
POSTINGS = "group int, block int, term string, n int, most int, least int, places array<int>, tfs array<int>, lengths array<int>"


def _postings(chunks: DataFrame) -> DataFrame:
    """POSTINGS of chunks (group, block, place, length, words), which have each block in one partition, in the order of group, block and place. One block is held at a time; its words stay in
    Arrow, as numbers of a dictionary."""

    def of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        words = table["words"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        place, length = (table[c].to_numpy() for c in ("place", "length"))
        pairs, tf = np.unique(number[coded.indices.to_numpy()] * table.num_rows + pc.list_parent_indices(words).to_numpy(), return_counts=True)
        row = pairs % max(1, table.num_rows)
        ends = np.searchsorted(pairs, np.arange(len(order) + 1) * table.num_rows).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place[row], tf, length[row])]
        most, least = (f.reduceat(x, ends[:-1]) if len(order) else x for f, x in ((np.maximum, tf), (np.minimum, length[row])))
        at = [pa.array(np.full(len(order), parts[0][c][0].as_py(), dtype=np.int32)) for c in ("group", "block")]
        return pa.RecordBatch.from_arrays([*at, coded.dictionary.take(pa.array(order)), *[pa.array(x.astype(np.int32)) for x in (np.diff(ends), most, least)], *lists], ["group", "block", "term", "n", "most", "least", "places", "tfs", "lengths"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[0]["block"][0].as_py() != block[a]:
                    yield of(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield of(held)

    return chunks.mapInArrow(each, POSTINGS)


def _write(located: DataFrame, folder: str, version: int, blocks: int) -> list[grouped.Part]:
    """Writes chunks and postings of located chunks (whole blocks) as one version. Texts are shuffled once for each of the two tables, single words never."""
    sized = _dealt(located, blocks).withColumn("length", F.size(tokens(F.col("content"))))
    place = F.row_number().over(Window.partitionBy("group", "block").orderBy("chunk_id")) - 1
    placed = sized.withColumn("place", place)
    parts = grouped.write(placed, folder, "chunks", version, "block", "place", dealt=True)
    stored = located.sparkSession.read.schema(placed.schema).parquet(f"{folder}/chunks/version={version}")
    texts = _dealt(stored.select("group", "block", "place", "length", "content"), blocks).sortWithinPartitions("group", "block", "place")
    rows = _postings(texts.filter("content is not null").select("group", "block", "place", "length", tokens(F.col("content")).alias("words")))
    return parts + grouped.write(rows, folder, "postings", version, "block", "term", dealt=True)


def opened(spark: SparkSession, folder: str) -> LexicalIndex:
    """The index that the folder's manifest names."""
    parts = grouped.manifest(spark, folder)
    chunks = grouped.read(spark, folder, parts, "chunks", "chunk_id string, doc_id long, chunk_index int, content string, length int, place int, block int, group int")
    return LexicalIndex(folder, parts[0]["size"], chunks, grouped.read(spark, folder, parts, "postings", "term string, n int, most int, least int, places array<int>, tfs array<int>, lengths array<int>, block int, group int"))


def built(chunks: DataFrame, folder: str) -> LexicalIndex:
    """Write an index of chunks (chunk_id, unique; doc_id, chunk_index, content, others kept) to an empty folder. Null contents have no postings but count as chunks. One writer at a time."""
    blocks = max(1, -(-chunks.count() // BLOCK_CHUNKS))
    grouped.publish(chunks.sparkSession, folder, blocks, 0, _write(_located(chunks, F.col("doc_id"), F.col("chunk_index"), blocks), folder, 0, blocks))
    return opened(chunks.sparkSession, folder)


def updated(index: LexicalIndex, gone: DataFrame, new: DataFrame) -> LexicalIndex:
    """The index without the chunks of gone (chunk_id) and with those of new (as in built(); in place of indexed ones with their ids), written as the next version.

    Only the groups that hold such chunks are read and written again; the others keep their files. Rankings are those of an index built anew: weights come from whole counts when it is read.
    """
    spark, folder = index.chunks.sparkSession, index.folder
    parts = grouped.manifest(spark, folder)
    version = max(r["version"] for r in parts) + 1
    leaving = written(gone.select("chunk_id").unionByName(new.select("chunk_id")).distinct())
    coming = written(index.located(new))
    hit = index.chunks.select("group", "chunk_id").join(if_small(leaving), "chunk_id", "left_semi").select("group").unionByName(coming.select("group"))
    touched = {r["group"] for r in hit.distinct().collect()}
    if not touched:
        return index
    stay = index.chunks.filter(F.col("group").isin(*touched)).join(if_small(leaving), "chunk_id", "left_anti").drop("place", "length")
    kept = [(r["kind"], r["group"], r["version"]) for r in parts if r["group"] not in touched and r["kind"] != "none"]
    grouped.publish(spark, folder, index.blocks, version, kept + _write(stay.unionByName(coming, allowMissingColumns=True), folder, version, len(touched) * GROUP_BLOCKS))
    return opened(spark, folder)
