"""Problem 9: the subject areas of each document.

Words and subwords (letter n-grams) hash to buckets with an embedding each; a text is the
average of its embeddings, and every subject has a logistic output of its own.  The labelled examples
stay in PARTS partitions, which train together as one barrier stage: in each round every partition computes the
gradient of its rows, all exchange their gradients, and each takes the same step (Adam) on the same sum.  A lost
executor repeats the stage.  As average and output are linear, a trained model is one row of logits per bucket, a table of fixed
size that is sent to the workers, which score every sentence of every document.

A sentence is about every subject that a logistic decision of its own gives at least one half, whatever the others get.  The
decision reads the sentence's logit for the subject and how much of the rest of the document is about it, since a word
may belong to several subjects; its three weights are the same for all subjects and are fitted on documents put together from
the examples that training left out.

The model is trained twice.  The few examples know few words, so the first model reads a sample of the documents, and
the sentences of those that are about one subject only join the examples of the second.

Both are bounded samples: at most ``MAX_EXAMPLES`` examples and ``MAX_DOCUMENTS`` documents, those with the least hash
of their id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import kept, map_columns, token
from folioflow.llm.sentences import sentence_ends
from folioflow.sources.tables import checkpointed, table

MAX_EXAMPLES = 50_000
MAX_DOCUMENTS = 1_000
#: A sampled document gives examples if so much of it is about one subject, and less than ``OTHER`` about any other.
CLEAR, OTHER = 0.5, 0.1
BUCKETS = 1 << 16
SIZE = 16
ROUNDS = 40
STEP = 0.2
DECAY = 1e-5
PARTS = 4
#: One example of so many is left out of training, for the weights of the decision.
FOLDS = 5
#: Documents put together to fit the weights of the decision, and what is added to a document's count of a subject.
MADE, SMOOTH = 1500, 0.3
#: A document is about a subject from this share of its sentences on.
SHARE = 0.25

_STOP = re.compile(r"[.!?…।。！？][”»’'\")\]」』“ ]*$")
_SOFT = re.compile(r"(?<=[^\W\d_])[-‐¬\u00ad]\s*$")
_ALONE = re.compile(r"[\W\d_]*(?:(?:page|seite|página|p|s|chapter|part|book|kapitel|teil|chapitre|partie|capítulo|parte)\b\.?\s*)?[\divxlc]*[\W\d_]*(?:(?:of|von|de|sur)\s*\d+[\W_]*)?", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1


def word_buckets(word: str) -> list[int]:
    """Buckets of a lower-case word and of its subwords of 4 to 6 letters, with marks for its ends."""
    out = [_hash(word)]
    if len(word) > 3:
        marked = f"<{word}>"
        out += [_hash(marked[i : i + n]) for n in (4, 5, 6) for i in range(len(marked) - n + 1)]
    return out


def is_name(word: str, known: frozenset[str]) -> bool:
    """Whether a word with a capital isn't among the words of two examples, so tells nothing."""
    return word[0].isupper() and word.lower() not in known


def text_buckets(text: str, known: frozenset[str], cache: dict[str, list[int]]) -> list[int]:
    """Buckets of all words but names; bucket 0 where nothing else is left."""
    out: list[int] = []
    for w in _WORD.findall(text):
        got = cache.get(w)
        if got is None:
            got = cache[w] = [] if is_name(w, known) else word_buckets(w.lower())
        out += got
    return out or [0]


def parts_of(text: str) -> list[str]:
    """The sentences of a text, lines of the page joined.

    Lines without a stop that stand alone (titles, page numbers, headings) are no sentences, unless
    the whole text has no stop.
    """
    paragraphs: list[str] = [""]
    for line in text.split("\n"):
        s = line.strip()
        if not s or _ALONE.fullmatch(s):
            if not s:
                paragraphs.append("")
            continue
        last = paragraphs[-1]
        if _SOFT.search(last):
            paragraphs[-1] = _SOFT.sub("", last) + s
        elif _STOP.search(last) or not last:
            paragraphs.append(s)
        else:
            paragraphs[-1] = f"{last} {s}"
    out, rest = [], []
    for p in paragraphs:
        at = 0
        for e in sentence_ends(p) if p else ():
            s, at = p[at:e], e
            if _WORD.search(s):
                (out if _STOP.search(s) else rest).append(s)
    return out or rest


class Rows:
    """Examples as flat bucket lists, for averaging."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, labels: np.ndarray):
        self.flat, self.size = flat.astype(np.int64), size.astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(size)), self.size)[order]  # by bucket
        self.touched, self.first = np.unique(self.flat[order], return_index=True)
        self.labels = labels


def gradient(rows: Rows, emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(touched buckets, gradient of their embeddings, of the outputs, of the biases)."""
    mean = np.add.reduceat(emb[rows.flat], rows.start, axis=0) / rows.size[:, None]
    err = 1 / (1 + np.exp(-(mean @ out + bias))) - rows.labels
    back = (err @ out.T) / rows.size[:, None]
    return rows.touched, np.add.reduceat(back[rows.owner], rows.first, axis=0), mean.T @ err, err.sum(0)


class Adam:
    def __init__(self, shape: tuple[int, ...], step: float):
        self.m, self.v, self.step, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), step, 0

    def take(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        x -= self.step * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def example_lists(texts: list[str | None], subjects: list[str | None], out_of: list[bool], names: list[str], known: frozenset[str]) -> list[tuple[list[int], int, bool]]:
    """(buckets, label, left out of training) of each example whole and of each of its sentences."""
    out, cache = [], {}
    for t, s, held in zip(texts, subjects, out_of):
        if not t or s not in names:
            continue
        k = names.index(s)
        sents = parts_of(t)
        out += [(text_buckets(x, known, cache), k, held) for x in (sents + [t] if len(sents) > 1 else sents)]
    return out


def pack(lists: list[tuple[list[int], int]], n: int) -> Rows:
    """Rows of (buckets, label)."""
    labels = np.zeros((len(lists), n))
    labels[np.arange(len(lists)), [k for _, k in lists]] = 1
    flat = np.concatenate([np.array(x, np.int32) for x, _ in lists]) if lists else np.zeros(0, np.int32)
    return Rows(flat, np.array([len(x) for x, _ in lists], np.int32), labels)


def start(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.uniform(-0.5 / SIZE, 0.5 / SIZE, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.1, (SIZE, n)), np.full(n, -2.0)


def fit(gradients, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(logits of each bucket, biases); ``gradients`` gives those of all partitions for the parameters."""
    emb, out, bias = start(n)
    steps = [Adam(emb.shape, STEP), Adam(out.shape, STEP), Adam(bias.shape, STEP)]
    for _ in range(rounds):
        ge, go, gb, rows = np.zeros_like(emb), np.zeros_like(out), np.zeros_like(bias), 0
        for touched, g, o, b, k in gradients(emb, out, bias):
            ge[touched] += g
            go += o
            gb += b
            rows += k
        if not rows:
            break
        for s, x, g in zip(steps, (emb, out, bias), (ge, go, gb)):
            s.take(x, g / rows + DECAY * x)
    return (emb @ out).astype(np.float32), bias.astype(np.float32)


class Model:
    """Scores sentences; a word's logits are summed over its buckets once."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, known: frozenset[str], weights: np.ndarray):
        self.table, self.bias, self.known, self.weights = table, bias, known, weights
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, self.table.shape[1]), np.float32)
        self.counts = np.zeros(1024, np.int64)

    def _add(self, w: str) -> int:
        k = len(self.index)
        if k >= len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        b = [] if is_name(w, self.known) else word_buckets(w.lower())
        self.sums[k], self.counts[k] = self.table[b].sum(0), len(b)
        self.index[w] = k
        return k

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row of logits per text; a text without words other than names gets the biases."""
        if len(self.index) > 300_000:
            self._clear()
        flat: list[int] = []
        size = np.zeros(len(texts), np.int64)
        get, add = self.index.get, self._add
        for i, t in enumerate(texts):
            words = _WORD.findall(t)
            flat += [k if (k := get(w)) is not None else add(w) for w in words]
            size[i] = len(words)
        out = np.tile(self.bias, (len(texts), 1))
        full = np.flatnonzero(size)
        if len(full):
            f = np.array(flat, np.int64)
            at = (np.cumsum(size) - size)[full]
            count = np.add.reduceat(self.counts[f], at)
            total = np.add.reduceat(self.sums[f], at, axis=0)
            none = count == 0
            total[none], count[none] = self.table[0], 1
            out[full] += total / count[:, None]
        return out


Parameters = tuple[np.ndarray, np.ndarray, frozenset[str], np.ndarray]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def around(logits: np.ndarray) -> np.ndarray:
    """For each sentence of a document (rows) and each subject, the log of the subject's share of the other sentences."""
    p = _logistic(logits)
    return np.log((p.sum(0) - p + SMOOTH) / (len(p) - 1 + SMOOTH * p.shape[1]))


def decision_weights(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of (logit, ``around``, 1), by logistic regression over documents of one to three subjects put together from rows."""
    rng = np.random.default_rng(9)
    groups = [g for g in (np.flatnonzero(labels[:, k]) for k in range(labels.shape[1])) if len(g)]
    x, y = [], []
    for _ in range(MADE if groups else 0):
        own = rng.choice(len(groups), size=min(int(rng.integers(1, 4)), len(groups)), replace=False)
        picked = rng.choice(own, size=int(rng.integers(3, 13)), p=rng.dirichlet(np.full(len(own), 2.0)))
        rows = np.array([rng.choice(groups[k]) for k in picked])
        x.append(np.stack([logits[rows], around(logits[rows])], 2).reshape(-1, 2))
        y.append(labels[rows].reshape(-1))
    w = np.array([1.0, 0.0, 0.0])
    if not x:
        return w
    z, true = np.column_stack([np.concatenate(x), np.ones(sum(map(len, x)))]), np.concatenate(y)
    for _ in range(30):  # Newton's steps
        p = _logistic(z @ w)
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(3), z.T @ (true - p) - 1e-3 * w)
    return w


def _known(examples: DataFrame) -> frozenset[str]:
    """Words that at least two of the examples hold: at most those of a bounded sample."""

    def words(c: dict[str, list]) -> dict[str, list]:
        out = Counter(w for t in c["text"] for w in {x.lower() for x in _WORD.findall(t)})
        return {"word": list(out), "n": list(out.values())}

    rows = map_columns(examples.select("text"), words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return frozenset(r[0] for r in rows.select("word").collect())


def _parts(spark: SparkSession) -> int:
    """PARTS where a barrier stage of so many tasks can run, else 1: the sample is bounded, so one task can train on it."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true" or spark.sparkContext.defaultParallelism < PARTS:
        return 1
    return PARTS


class Exchange:
    """Gives every task of a barrier stage what each of them sends, in order of the tasks; the first task passes it on."""

    WAIT = 120  #: seconds for a task that sends nothing, after which the stage fails and is repeated

    def __init__(self, task, key: bytes):
        self.rank = task.partitionId()
        host = task.getTaskInfos()[0].address.rsplit(":", 1)[0]
        hub = Listener(("", 0), backlog=64, authkey=key) if self.rank == 0 else None
        port = int(next(x for x in task.allGather(str(hub.address[1]) if hub else "") if x))
        if hub:
            others = [hub.accept() for _ in task.getTaskInfos()[1:]]
            self.others = dict(sorted((self._got(c), c) for c in others))
            hub.close()
        else:
            self.hub = Client((host, port), authkey=key)
            self.hub.send(self.rank)

    def _got(self, connection):
        if not connection.poll(self.WAIT):
            raise TimeoutError("a task of the stage sends nothing")
        return connection.recv()

    def exchange(self, own) -> list:
        if self.rank:
            self.hub.send(own)
            return self._got(self.hub)
        every = [own, *(self._got(c) for c in self.others.values())]
        for c in self.others.values():
            c.send(every)
        return every


def _fit(examples: DataFrame, names: list[str], rounds: int) -> Parameters:
    """Trains on the partitions of (subject, text, held), a bounded sample; the driver gets the trained table and the logits of the examples left out.

    Where the tasks can't reach one another, the barrier stage fails and one task trains.
    """
    parts, known = _parts(examples.sparkSession), _known(examples)
    try:
        return _train(examples, names, rounds, known, parts)
    except Exception:
        if parts == 1:
            raise
        return _train(examples, names, rounds, known, 1)


def _train(examples: DataFrame, names: list[str], rounds: int, known: frozenset[str], parts: int) -> Parameters:
    spark, n, key = examples.sparkSession, len(names), os.urandom(16)
    sent = spark.sparkContext.broadcast(known)
    kind = "part int, logits binary, bias binary, score binary, label binary"
    arrow = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("logits", "bias", "score", "label"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext, TaskContext

        lists = []
        for b in batches:
            lists += example_lists(b.column("text").to_pylist(), b.column("subject").to_pylist(), b.column("held").to_pylist(), names, sent.value)
        rows, held = (pack([(x, k) for x, k, h in lists if h == left], n) for left in (False, True))
        ring = Exchange(BarrierTaskContext.get(), key) if parts > 1 else None

        def gradients(*parameters: np.ndarray) -> Iterator[tuple]:
            own = (*gradient(rows, *parameters), len(rows.size)) if len(rows.size) else None
            yield from (got for got in (ring.exchange(own) if ring else [own]) if got is not None)

        logits, bias = fit(gradients, n, rounds)
        score = np.add.reduceat(logits[held.flat], held.start, axis=0) / held.size[:, None] + bias if len(held.size) else np.zeros((0, n))
        part = TaskContext.get().partitionId()
        model = (logits.tobytes(), bias.tobytes()) if part == 0 else (None, None)
        yield pa.RecordBatch.from_pylist([{"part": part, "logits": model[0], "bias": model[1], "score": score.astype(np.float32).tobytes(), "label": held.labels.astype(np.int8).tobytes()}], schema=arrow)

    out = sorted(examples.repartition(parts, F.xxhash64("text")).mapInArrow(run, kind, barrier=parts > 1).collect(), key=lambda r: r["part"])
    sent.destroy()
    scores = np.concatenate([np.frombuffer(r["score"], np.float32).reshape(-1, n) for r in out]).astype(float)
    labels = np.concatenate([np.frombuffer(r["label"], np.int8).reshape(-1, n) for r in out])
    return np.frombuffer(out[0]["logits"], np.float32).reshape(-1, n), np.frombuffer(out[0]["bias"], np.float32), known, decision_weights(scores, labels)


def _clear_documents(docs: DataFrame, names: list[str], parameters: Parameters) -> DataFrame:
    """(subject, text, held): all sentences of the sampled documents that are about one subject only; one document of FOLDS is held out."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text", (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held"))
    sent, name = docs.sparkSession.sparkContext.broadcast(parameters), token()

    def label(c: dict[str, list], model: Model) -> dict[str, list]:
        out: dict[str, list] = {"subject": [], "text": [], "held": []}
        for t, held, found_ in zip(c["text"], c["held"], document_subjects(c["text"], model, names)):
            best = sorted(found_, key=lambda x: (-x[1], x[0]))
            if best and best[0][1] >= CLEAR and all(x < OTHER for _, x in best[1:]):
                own = parts_of(t)
                out["subject"] += [best[0][0]] * len(own)
                out["text"] += own
                out["held"] += [held] * len(own)
        return out

    return map_columns(sample, label, "subject string, text string, held boolean", lambda: kept(name, lambda: Model(*sent.value)))


def train(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> tuple[list[str], Parameters]:
    """(subjects, (logits of each bucket, biases, known words, weights of the decision)), trained on subject_examples and clear documents."""
    names = sorted(r[0] for r in table(spark, sf_dir, "subjects").select("subject").where(F.col("subject").isNotNull()).distinct().collect())
    examples = table(spark, sf_dir, "subject_examples").where(F.col("text").isNotNull() & F.col("subject").isin(names))
    bounded = examples.dropDuplicates(["example_id"]).orderBy(F.xxhash64("example_id"), "example_id").limit(MAX_EXAMPLES)
    # every FOLDS-th example of a subject is left out, so the first ones always train; a window over the bounded sample
    nth = F.row_number().over(Window.partitionBy("subject").orderBy(F.xxhash64("example_id"), "example_id", "text"))
    bounded = bounded.select("subject", "text", (nth % FOLDS == 0).alias("held"))
    if not names or bounded.isEmpty():
        return names, (np.zeros((BUCKETS, len(names)), np.float32), np.full(len(names), -99, np.float32), frozenset(), np.array([1.0, 0.0, 0.0]))
    bounded = checkpointed(bounded)
    first = _fit(bounded, names, rounds)
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    more = checkpointed(_clear_documents(docs, names, first))
    return names, _fit(bounded.unionByName(more), names, rounds)


def document_subjects(texts: list[str | None], model: Model, names: list[str]) -> list[list[tuple[str, float]]]:
    """For each text, (subject, share of its sentences) of all subjects of any sentence; each subject is decided by itself."""
    sents: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        own = parts_of(t) if t else []
        sents += own
        owner += [i] * len(own)
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    if not sents:
        return out
    logits, own = model.logits(sents).astype(float), np.array(owner)
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    rest = np.concatenate([around(logits[a:b]) for a, b in zip(edges, edges[1:])])
    about = logits * model.weights[0] + rest * model.weights[1] + model.weights[2] >= 0
    total = np.bincount(owner, minlength=len(texts))
    for k, name in enumerate(names):
        hits = np.bincount(owner, about[:, k], minlength=len(texts))
        for i in np.flatnonzero(hits):
            out[i].append((name, float(hits[i] / total[i])))
    return out


def subject_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject, share): the share of a document's sentences about each subject, where above 0."""
    names, parameters = train(spark, sf_dir)
    if not names:
        return spark.createDataFrame([], "doc_id bigint, subject string, share double")
    sent, name = spark.sparkContext.broadcast(parameters), token()

    def score(c: dict[str, list], model: Model) -> dict[str, list]:
        found_ = document_subjects(c["text"], model, names)
        return {"doc_id": c["doc_id"], "s": [[{"subject": s, "share": round(x, 6)} for s, x in row] for row in found_]}

    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    rows = map_columns(docs, score, "doc_id bigint, s array<struct<subject:string,share:double>>", lambda: kept(name, lambda: Model(*sent.value)))
    return rows.select("doc_id", F.inline("s"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, subject) of every subject that at least a quarter of a document's sentences are about."""
    return subject_shares(spark, sf_dir).where(F.col("share") >= SHARE).select("doc_id", "subject")
