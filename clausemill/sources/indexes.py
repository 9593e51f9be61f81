"""Persisted search indexes: postings of words and trigrams, and an inverted file of vectors.

An index is a folder of Parquet tables. Postings lie in folders by bucket of their term, vectors in folders by list, so a
question reads the folders of its own terms or of the lists nearest to it, and no others. Rows are added in generations;
what is deleted leaves a tombstone, which rows of later generations outlive. Readers see the generations that were there
when they opened the index.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausemill.functions.text import cosine, tokens, trigrams
from clausemill.operators import fusion, retrieval

#: Folders of terms, and files that a generation has in each at most.
BUCKETS, FILES = 256, 4
#: Characters of a text that trigrams are taken of, unless an index is to have them of whole texts.
CHARS = 2000
#: Vectors that lists are fitted on, for each list in expectation, and rounds of the fit.
SAMPLE, ROUNDS = 256, 12


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder below spark.checkpoint.dir that no other index has. Where that is unset, a local session gets a temporary
    one; a cluster's executors couldn't share it, so there it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clausemill-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _spread(chunks: DataFrame) -> DataFrame:
    """Chunks dealt over the cores: a file with few row groups is read by few tasks, however large it is."""
    tasks = max(4 * chunks.sparkSession.sparkContext.defaultParallelism, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks.repartition(tasks, "id")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Postings:
    """Postings of chunks(id, text, heading, clause_number).

    words/bucket=  word, chunk_id, tf (in the search text), in_text, weight (of its best place), dl
    grams/bucket=  gram, chunk_id, side (0 heading and number, 1 text), n (trigrams of the side)
    chunks         chunk_id, dl, words: for statistics and deletes
    vocabulary     word, df: negative where chunks were deleted
    tombstones     chunk_id, before: the generation from which on the chunk may be back

    chars: characters of a text that its trigrams are taken of, None for the whole text.
    """

    def __init__(self, spark: SparkSession, path: str, chars: int | None = CHARS):
        self.spark, self.path, self.chars = spark, path, chars

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.path}/{table}"
        return self.spark.read.schema(schema).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self._read("tombstones", "chunk_id long, before int").groupBy("chunk_id").agg(F.max("before").alias("before"))
        return rows.join(dead, "chunk_id", "left").where("before IS NULL OR generation >= before").drop("before")

    def generations(self) -> int:
        found = self._read("chunks", "chunk_id long, dl int, words array<string>, generation int").agg(F.max("generation")).first()[0]
        return 0 if found is None else found + 1

    def append(self, chunks: DataFrame) -> Postings:
        """Add chunks as a new generation. A chunk that is there already has to be deleted first."""
        generation = F.lit(self.generations()).alias("generation")
        cuts = _spread(chunks).select(F.col("id").alias("chunk_id"), "text", "heading", "clause_number", *[tokens(F.col(c)).alias(n) for c, n in (("text", "body"), ("heading", "head"), ("clause_number", "number"))])
        # the words of the search text are those of its parts, and a word's place tells its part; sizes are taken before
        # words part, so that none carries the chunk's arrays
        own = cuts.select("chunk_id", "text", "heading", "clause_number", F.concat("body", "head", "number").alias("words"), F.size("body").alias("b"), (F.size("body") + F.size("head")).alias("h")).withColumn("dl", F.size("words"))
        each = own.select("chunk_id", "dl", "b", "h", F.posexplode("words").alias("i", "word"))
        weight = F.when(F.col("i") < F.col("b"), 0.2).when(F.col("i") < F.col("h"), 1.0).otherwise(0.4)
        counted = each.groupBy("chunk_id", "word", "dl").agg(F.count("*").cast("int").alias("tf"), F.max(F.col("i") < F.col("b")).alias("in_text"), F.max(weight).alias("weight"))
        counted = counted.select("chunk_id", "word", "tf", "dl", "in_text", "weight")
        self._write("words", counted, "word", generation)
        head = trigrams(F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("clause_number", F.lit(""))))
        start = F.col("text") if self.chars is None else F.substring("text", 1, self.chars)
        sides = own.select("chunk_id", F.posexplode(F.array(head, trigrams(start))).alias("side", "grams"))
        self._write("grams", sides.withColumn("n", F.size("grams")).select("chunk_id", "side", "n", F.explode("grams").alias("gram")), "gram", generation)
        kept = own.select("chunk_id", "dl", F.array_distinct("words").alias("words"), generation)
        kept.write.mode("append").parquet(f"{self.path}/chunks")
        kept.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).write.mode("append").parquet(f"{self.path}/vocabulary")
        return self

    def _write(self, table: str, rows: DataFrame, term: str, generation: Column) -> None:
        placed = rows.select("*", generation, _bucket(F.col(term)).alias("bucket"))
        # a frequent term's postings come from several tasks, so that none writes them all
        spread = placed.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(FILES)))
        spread.sortWithinPartitions("bucket", term, "chunk_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{table}")

    def delete(self, ids: DataFrame) -> Postings:
        """Take the chunks ids(chunk_id) out of the index: a tombstone each, and their words off the vocabulary."""
        gone = self.chunks().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        words = gone.select(F.explode("words").alias("word")).groupBy("word").agg((-F.count("*")).alias("df"))
        words.write.mode("append").parquet(f"{self.path}/vocabulary")
        gone.select("chunk_id", F.lit(self.generations()).alias("before")).write.mode("append").parquet(f"{self.path}/tombstones")
        return self

    def chunks(self) -> DataFrame:
        return self._live(self._read("chunks", "chunk_id long, dl int, words array<string>, generation int"))

    def vocabulary(self) -> DataFrame:
        return self._read("vocabulary", "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).where("df > 0")

    def words(self, asked: DataFrame) -> DataFrame:
        """Postings of the words of asked(word, ...), read from their folders alone."""
        rows = self._read("words", "chunk_id long, word string, tf int, dl int, in_text boolean, weight double, generation int, bucket int")
        return self._live(self._found(rows, asked, "word")).drop("generation")

    def grams(self, asked: DataFrame) -> DataFrame:
        rows = self._read("grams", "chunk_id long, side int, n int, gram string, generation int, bucket int")
        return self._live(self._found(rows, asked, "gram")).drop("generation")

    def _found(self, rows: DataFrame, asked: DataFrame, term: str) -> DataFrame:
        """The batch's terms are few; as values they prune folders when the plan is made and row groups when it runs."""
        wanted = [r[0] for r in asked.select(term).distinct().collect()]
        buckets = {r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], f"{term} string").select(_bucket(F.col(term))).distinct().collect()} if wanted else set()
        return rows.where(F.col("bucket").isin(sorted(buckets)) & F.col(term).isin(sorted(wanted))).drop("bucket")

    # -- signals: the same rows as without the index ---------------------------------------------------

    def bm25(self, terms: DataFrame) -> DataFrame:
        """query_id, chunk_id, score > 0, as retrieval.bm25."""
        asked = terms.select("query_id", F.explode(tokens(F.col("term"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))
        size = self.chunks().agg(F.count("*").alias("size"), F.avg("dl").alias("avgdl"))
        idf = (F.log(F.col("size") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")
        # of the vocabulary only how many words have which count is summed up, as in retrieval.bm25
        kinds = self.vocabulary().groupBy("df").agg(F.count("*").alias("words")).crossJoin(F.broadcast(size)).select("words", idf)  # one row
        mean = kinds.agg((F.sum(F.col("words") * F.col("idf")) / F.sum("words")).alias("mean"))
        weights = asked.join(self.vocabulary(), "word").crossJoin(F.broadcast(size)).select("query_id", "word", "times", "avgdl", idf).crossJoin(F.broadcast(mean))
        w = F.col("times") * F.when(F.col("idf") < 0, retrieval.EPSILON * F.col("mean")).otherwise(F.col("idf"))
        part = w * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.col("avgdl")))
        return self.words(asked).join(weights, "word").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")

    def any_word(self, terms: DataFrame, limit: int) -> DataFrame:
        """query_id, chunk_id, rank, as retrieval.any_word."""
        asked = terms.select("query_id", F.explode(tokens(F.col("term"))).alias("word")).distinct()
        hits = self.words(asked).where("in_text").join(asked, "word").select("query_id", "chunk_id").distinct()
        w = Window.partitionBy("query_id").orderBy("chunk_id")
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)

    def weighted_match(self, terms: DataFrame) -> DataFrame:
        """query_id, chunk_id, score, as retrieval.weighted_match: chunks that have all words."""
        asked = terms.select("query_id", F.explode(tokens(F.col("term"))).alias("word")).distinct()
        need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
        hits = self.words(asked).where("weight > 0").join(asked, "word").groupBy("query_id", "chunk_id").agg(F.count("*").alias("has"), F.sum("weight").alias("score"))
        return hits.join(need, "query_id").where("has = need").select("query_id", "chunk_id", "score")

    def trigram(self, terms: DataFrame, threshold: float = retrieval.TRIGRAM_THRESHOLD) -> DataFrame:
        """query_id, term_pos, chunk_id, score, as retrieval.trigram over as many characters."""
        asked = terms.select("query_id", "term_pos", trigrams(F.col("term")).alias("all")).select("query_id", "term_pos", F.size("all").alias("m"), F.explode("all").alias("gram"))
        hits = self.grams(asked).join(asked, "gram").groupBy("query_id", "term_pos", "chunk_id", "side", "n", "m").agg(F.count("*").alias("hits"))
        score = F.max(F.col("hits") / (F.col("n") + F.col("m") - F.col("hits")))
        return hits.groupBy("query_id", "term_pos", "chunk_id").agg(score.alias("score")).where(F.col("score") >= threshold)


class Vectors:
    """An inverted file of vectors(vec_id, embedding): each lies in the list of its nearest centre, by cosine.

    Centres are fitted on a bounded sample, SAMPLE vectors for each list in expectation; every vector is indexed. A search
    with as many probes as lists is exact. Null vectors and those without a direction aren't indexed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # as many as lists
        return np.array([r.centre for r in rows], np.float64)

    def build(self, vectors: DataFrame, lists: int) -> Vectors:
        good = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
        total = good.count()
        share = min(1.0, SAMPLE * lists / max(1, total))
        sample = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * share)) if share < 1 else good
        centres = fitted(_unit(np.array([r.embedding for r in sample.orderBy("vec_id").collect()], np.float64)), lists)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self.append(good)

    def append(self, vectors: DataFrame) -> Vectors:
        centres = self.centres()

        def run(batches):
            for b in batches:
                x = _unit(np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1))
                near = (x @ centres.T).argmax(1) if x.size else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["vec_id", "embedding", "list"])

        kind = vectors.schema["embedding"].dataType.simpleString()
        placed = vectors.where("embedding IS NOT NULL AND exists(embedding, x -> x <> 0)").select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, list int")
        spread = placed.repartition(F.col("list"), F.pmod(F.xxhash64("vec_id"), F.lit(FILES)))
        spread.write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")
        return self

    def lists_of(self, queries: DataFrame, probes: int) -> list[tuple[int, int, int]]:
        """(query_id, term_pos, list): the nearest lists of a batch of queries(query_id, term_pos, vector)."""
        centres, out = self.centres(), []
        for r in queries.collect():  # a batch of questions
            near = _unit(np.array([r.vector], np.float64)) @ centres.T
            out += [(r.query_id, r.term_pos, int(i)) for i in np.argsort(-near[0], kind="stable")[:probes]]
        return out

    def search(self, queries: DataFrame, limit: int, probes: int) -> DataFrame:
        """query_id, chunk_id, rank, as retrieval.vectors, over the vectors of the nearest lists."""
        wanted = self.lists_of(queries, probes)
        near = self.spark.createDataFrame(wanted, "query_id long, term_pos int, list int")
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(sorted({x[2] for x in wanted})))
        asked = near.join(queries, ["query_id", "term_pos"])
        scored = rows.join(F.broadcast(asked), "list").select("query_id", "term_pos", F.col("vec_id").alias("chunk_id"), cosine(F.col("embedding"), F.col("vector")).alias("score"))
        w = Window.partitionBy("query_id", "term_pos").orderBy(F.desc(F.round("score", 9)), "chunk_id")
        return fusion.concatenated(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit), limit)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-300)


def fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of at most so many lists, from unit vectors x, by spherical k-means from spread starts."""
    lists = max(1, min(lists, len(x)))
    if not len(x):
        return np.zeros((1, 1))
    start, far = [0], 1 - x @ x[0]
    while len(start) < lists:
        start.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[start[-1]])
    centres = x[start]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = np.bincount(near, minlength=lists) > 0
        centres = np.where(some[:, None], _unit(sums), centres)
    return centres
