"""Token plane: vocabularies, encoding, byte-pair training, windows, samples.

Character work is array expressions; byte-pair encoding merges each distinct word
of the corpus once, in Arrow batches, since merges never cross white space.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.checks import positive
from textloom.functions.schemas import OUTPUT_ROLES
from textloom.operators import merging
from textloom.operators.corpus import char_budget
from textloom.operators.order import totals
from textloom.sources import scratch

UNK, EOS = "<UNK>", X.EOS
#: Newline, then the printable ASCII characters, in the vocabulary's order.
PRINTABLE = ("\n", *map(chr, range(0x20, 0x7F)))


def distinct_characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token): a batch of texts gives each of its characters once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for t in batch.column("text").to_pylist():
                found.update((t or "").replace(EOS, ""))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["token"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token string").distinct()


def char_vocabulary(docs: DataFrame, text: str = "text") -> list[str]:
    """Printable ASCII, the corpus's other characters sorted, then the unknown and
    the end token. At most as many rows as there are code points reach the driver."""
    extra = [r.token for r in distinct_characters(docs, text).collect()]
    return [*PRINTABLE, *sorted(set(extra) - set(PRINTABLE)), UNK, EOS]


def char_ids(text: Column | str, vocabulary: Sequence[str]) -> Column:
    """Ids of a text's characters, the unknown id for others, the end id for each
    end marker. ASCII characters index a table; others look up a map."""
    place = {t: i for i, t in enumerate(vocabulary)}
    unk, end = place[UNK], place[EOS]
    table = F.array(*(F.lit(place.get(chr(i), unk)) for i in range(128)))
    extra = [(t, i) for t, i in place.items() if len(t) == 1 and ord(t) >= 128]

    def one(c: Column) -> Column:
        rare = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in extra for x in kv)), c), F.lit(unk)) if extra else F.lit(unk)
        return F.when(F.ascii(c) < 128, F.get(table, F.ascii(c))).otherwise(rare)

    ids = lambda p: F.transform(X.characters(p), one)
    whole = F.col(text) if isinstance(text, str) else text
    closed = F.flatten(F.transform(X.eos_parts(whole), lambda p, i: F.when(i > 0, F.concat(F.array(F.lit(end)), ids(p))).otherwise(ids(p))))
    return F.when(F.contains(whole, F.lit(EOS)), closed).otherwise(ids(whole))


def char_token_count(text: Column | str) -> Column:
    """How many ids char_ids gives, without giving them; 0 for null."""
    whole = F.coalesce(text, F.lit(""))
    rest = F.length(F.replace(whole, F.lit(EOS), F.lit("")))
    return (rest + (F.length(whole) - rest) / len(EOS)).cast("long")


def decode(tokens: Column, vocabulary: Sequence[str]) -> Column:
    """Text up to the first end token; the replacement character for unknown ones;
    an id outside the vocabulary raises."""
    names = F.array(*(F.lit("�" if t == UNK else t) for t in vocabulary))
    end = F.array_position(tokens, vocabulary.index(EOS))
    kept = F.when(end > 0, F.slice(tokens, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(tokens)
    bad = F.exists(tokens, lambda t: (t < 0) | (t >= len(vocabulary)))
    return F.when(bad, F.raise_error(F.lit("token id outside the vocabulary"))).otherwise(F.array_join(F.transform(kept, lambda t: F.element_at(names, t + 1)), ""))


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all texts."""
    return docs.select(F.explode(X.characters(F.replace(text, F.lit(EOS), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): what byte-pair training needs of a corpus."""
    return docs.select(F.explode(X.words(F.replace(text, F.lit(EOS), F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(first, second, n): neighbouring characters inside words, by word counts."""
    c = X.characters("word")
    pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    at = words.where(F.length("word") > 1).select(F.explode(pairs).alias("p"), "n")
    return at.groupBy("p.first", "p.second").agg(F.sum("n").alias("n"))


#: Leading characters of a corpus whose counts rank the base alphabet in the query bpe_alphabet.
SAMPLE_CHARACTERS = 250_000


def train_bpe(docs: DataFrame, vocab_size: int, order: str, text: str = "text", sample_characters: int | None = None, words: DataFrame | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Vocabulary and ranked merges, from all texts. The base alphabet is ranked by the
    characters' counts; words are split at characters outside it, and merging.learn counts
    all of them. Where the docs' bpe_words are stored already, `words` is these. Only if
    sample_characters is given, counts come from as many characters, the first in the
    given order; all other characters of the corpus come behind, with count 0."""
    if vocab_size < 3:
        raise ValueError("vocab_size must be at least 3")
    if sample_characters is not None and sample_characters < 1:
        raise ValueError("sample_characters must be positive")
    if sample_characters is not None:
        words = bpe_words(char_budget(docs.select(order, text), sample_characters, order, text), text)
    elif words is None:
        words = bpe_words(docs, text)
    words = words.where("trained > 0").select("word", F.col("trained").alias("n"))
    known = letter_counts(words)
    if sample_characters is not None:
        known = known.unionByName(distinct_characters(docs, text).withColumn("n", F.lit(0).cast("long")))
    ranked = known.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(min(256, vocab_size - 2)).collect()
    if not ranked:
        raise ValueError("training text must not be empty")
    alphabet = sorted(r.token for r in ranked)
    merges = merging.learn(words, alphabet, vocab_size - 2)
    return [*sorted({*alphabet, *(a + b for a, b in merges)}), UNK, EOS], merges


def check_vocabulary(vocabulary: Sequence[str], merges: Sequence[tuple[str, str]] = ()) -> None:
    """Raises unless tokens are distinct, the end token is last, and merges are
    distinct and made of tokens."""
    known = set(vocabulary)
    if not vocabulary or len(known) < len(vocabulary):
        raise ValueError("the vocabulary is empty or repeats a token")
    if EOS in known and vocabulary[-1] != EOS:
        raise ValueError("the end token must be the last one")
    if len(set(merges)) < len(merges) or any(t not in known for a, b in merges for t in (a, b, a + b)):
        raise ValueError("merges repeat or use unknown tokens")


#: Characters of a word that is merged where it stands.
HEAD_LENGTH = 64


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word after all merges: the pair of the lowest rank that is there is
    merged wherever it is, from the left, before any other. Symbols are a linked list
    and mergeable pairs wait in a heap, so that the cost follows the merges made."""
    symbols: list[str] = list(word)
    n = len(symbols)
    if n <= HEAD_LENGTH:  # a scan for each merge is less than a heap
        none = len(ranks)
        own = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
        while own and (least := min(own)) < none:
            i = own.index(least)
            while i >= 0:
                symbols[i] += symbols.pop(i + 1)
                del own[i]
                if i < len(own):
                    own[i] = ranks.get((symbols[i], symbols[i + 1]), none)
                if i:
                    own[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
                i = own.index(least, i) if least in own else -1
        return symbols
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(p)) is not None]
    heapify(heap)
    made: list[tuple[int, int]] = []  # pairs of a lower rank than that being merged
    now = -1
    while heap or made:
        if made and (not heap or heap[0][0] != now):
            for entry in made:
                heappush(heap, entry)
            made = []
        now, i = heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != now:
            continue  # one of its symbols has gone
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = after[j]
        if after[i] < n:
            ahead[after[i]] = i
        for k in (ahead[i], i):
            if k >= 0 and after[k] < n:
                r = ranks.get((symbols[k], symbols[after[k]]))
                if r is not None:
                    if r < now:
                        made.append((r, k))
                    else:
                        heappush(heap, (r, k))
    return [s for s in symbols if s]


#: Words of a corpus that an encoder looks up, and others that a task remembers.
HEAD_WORDS, TASK_WORDS = 1 << 17, 1 << 17


WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def bpe_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, trained) of the corpus's distinct words; a stored table. n counts words
    that end at end markers, as in encoding; trained is for training, which takes end
    markers out first, and also has a row for each white-space character, with n 0."""
    scratch.shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found: Counter = Counter()
                more: Counter = Counter()  # that training counts, besides
                for t in whole.column("text").slice(at, 1024).to_pylist():
                    t = t or ""
                    words = t.replace(EOS, " ").split()
                    found.update(words)
                    if EOS in t:
                        more.subtract(words)
                        t = t.replace(EOS, "")
                        more.update(t.split())
                    for c in WHITE:
                        if k := t.count(c):
                            more[c] += k
                names = [*found, *(w for w in more if w not in found)]
                n = [found[w] for w in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array([k + more[w] for w, k in zip(names, n)], pa.int64())], ["word", "n", "trained"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long, trained long")
    return scratch.table(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")))


def letter_counts(words: DataFrame) -> DataFrame:
    """(token, n): characters of words (word, n); a task gives each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0x110000, np.int64)
        for batch in batches:
            words = batch.column("word").to_pylist()
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            sums += merging.total(codes, np.repeat(batch.column("n").to_numpy(), [len(w) for w in words]), len(sums))
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(map(chr, found.tolist()), pa.string()), pa.array(sums[found])], ["token", "n"])

    scratch.shipped(words.sparkSession)
    return words.select("word", "n").mapInArrow(run, "token string, n long")


def _merged(words: DataFrame, ids: dict[str, int], ranks: dict[tuple[str, str], int]) -> DataFrame:
    """(word, ids) of distinct words, each merged once."""
    unk = ids[UNK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[ids.get(s, unk) for s in merge_word(w, ranks)] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with the greatest n, at most `most` of them: the threshold comes from
    a histogram with eight bars a doubling."""
    bar = F.floor(F.log2("n") * 8).cast("int")
    short = words.where(F.length("word") <= HEAD_LENGTH)
    total, least = 0, None
    for r in sorted(short.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["bar"]):
        total += r["rows"]
        if total > most:
            break
        least = r["bar"]
    return short.where(bar >= least) if least is not None else short.limit(0)


def bpe_encode(docs: DataFrame, vocabulary: Sequence[str], merges: Sequence[tuple[str, str]], text: str = "text", name: str = "tokens", head: int = HEAD_WORDS, words: DataFrame | None = None) -> DataFrame:
    """docs with the token ids of each text (null for null). The corpus's most frequent
    words are merged once and looked up where the text is; other short ones are merged
    there, and the last TASK_WORDS of a task are remembered. Of words of more than
    HEAD_LENGTH characters, which cost more, a text names its distinct ones; the corpus's
    are merged once, joined by word and put into their places. Columns of any name are
    carried. Where the docs' bpe_words are stored already, `words` is these."""
    ids = {t: i for i, t in enumerate(vocabulary)}
    unk, end = ids[UNK], ids[EOS]
    ranks = {p: i for i, p in enumerate(merges)}
    words = (bpe_words(docs, text) if words is None else words).where("n > 0")
    table = {r.word: r.ids for r in _merged(_frequent(words, head), ids, ranks).collect()}
    long = words.where(F.length("word") > HEAD_LENGTH)
    all_known = long.isEmpty()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [f for f in docs.schema.fields if f.name != name]
    carried = [T.StructField(f"c{i}__", f.dataType) for i, f in enumerate(fields)]
    own = carried[[f.name for f in fields].index(text)].name
    schema = T.StructType(carried + T.StructType.fromDDL("row__ long, parts__ array<struct<ids:array<int>,rare:int>>, rare__ array<string>").fields)
    pieces, marked = re.compile(r"\S+|\s"), re.compile(r"<EOS>|\s|(?:(?!<EOS>)\S)+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = {w: array("i", i).tobytes() for w, i in shared.value.items()}
        look_up |= {c: array("i", [ids.get(c, unk)]).tobytes() for c in map(chr, range(0x3001)) if c.isspace()}
        look_up[EOS] = array("i", [end]).tobytes()
        near: dict[str, bytes] = {}
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                # all ids of the batch, where its parts end, what closes a part, and where rows end
                flat, part_ends, closed, row_ends = bytearray(), [0], [], [0]
                rare: list = []
                for t in batch.column(own).to_pylist():
                    words_ = pieces.findall(t or "") if t is None or EOS not in t else marked.findall(t)
                    got = list(map(look_up.get, words_))
                    names: dict[str, int] = {}
                    lo = 0
                    i = -1
                    for _ in range(got.count(None)):
                        i = got.index(None, i + 1)
                        w = words_[i]
                        if len(w) <= HEAD_LENGTH:
                            made = near.get(w)
                            if made is None:
                                if len(near) >= TASK_WORDS:
                                    near.clear()
                                made = near[w] = array("i", [ids.get(s, unk) for s in merge_word(w, ranks)]).tobytes()
                            got[i] = made
                            continue
                        flat += b"".join(got[lo:i])
                        closed.append(names.setdefault(words_[i], len(names)))
                        part_ends.append(len(flat) // 4)
                        lo = i + 1
                    flat += b"".join(got[lo:])
                    if len(flat) > 4 * part_ends[-1]:
                        closed.append(-1)
                        part_ends.append(len(flat) // 4)
                    row_ends.append(len(closed))
                    rare.append(list(names))
                known_ids = pa.ListArray.from_arrays(pa.array(part_ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                parts = pa.StructArray.from_arrays([known_ids, pa.array(closed, pa.int32())], ["ids", "rare"])
                made = [pa.array(row + np.arange(batch.num_rows)), pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), parts), pa.array(rare, pa.list_(pa.string()))]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    missing = F.raise_error(F.lit("a word of a text is not among the corpus's")).cast("array<int>")
    cut = docs.select(*(F.col(f"`{f.name}`").alias(c.name) for f, c in zip(fields, carried))).mapInArrow(run, schema)
    restored = [F.col(c.name).alias(f.name) for f, c in zip(fields, carried)]
    if all_known:
        return cut.select(*restored, F.when(F.col(own).isNotNull(), F.flatten(F.col("parts__.ids"))).alias(name))
    held, words = scratch.table(cut), _merged(long, ids, ranks)
    asked = held.select("row__", F.posexplode("rare__").alias("at", "word"))
    found = asked.join(words.select("word", "ids"), "word").groupBy("row__").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("found__"))
    both = held.join(found, "row__", "left")
    own_ids = lambda p: F.when(p["rare"] >= 0, F.concat(p["ids"], F.coalesce(F.get(F.col("found__"), p["rare"])["ids"], missing))).otherwise(p["ids"])
    return both.select(*restored, F.when(F.col(own).isNotNull(), F.flatten(F.transform("parts__", own_ids))).alias(name))


def strided_windows(rows: DataFrame, tokens: str, length: int, stride: int) -> DataFrame:
    """rows with idx and window: length + 1 tokens from every stride-th place that
    has as many; ceil((n - length) / stride) of them."""
    positive(length=length, stride=stride)
    n = F.size(tokens)
    at = F.when(n > length, F.sequence(F.lit(0), n - length - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    out = rows.select("*", F.posexplode(at).alias("idx", "start__"))
    return out.withColumn("window", F.slice(tokens, F.col("start__") + 1, length + 1)).drop("start__")


def dense_windows(rows: DataFrame, tokens: str, length: int) -> DataFrame:
    """rows with idx and window: length tokens from every place that has as many."""
    positive(length=length)
    n = F.size(tokens)
    at = F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
    return rows.select("*", F.explode(at).alias("idx")).withColumn("window", F.slice(tokens, F.col("idx") + 1, length))


def capped_stream(rows: DataFrame, tokens: str, order: str, end: int, most: int | None = None, size: str | None = None) -> DataFrame:
    """rows as one token stream in the given order, cut after `most` tokens and
    closed by the end token unless it ends with one; adds start, the place of a
    row's first token. Without any token it raises. Where a column `size` has the
    number of a row's tokens, tokens are made for the rows that are kept only."""
    positive(most=most)
    n = F.size(F.coalesce(tokens, F.array().cast("array<int>"))).cast("long") if size is None else F.col(size)
    seen = totals(rows, n, order)
    last = seen.slim.where("value__ > 0").agg(F.max(order).alias("last")).first()["last"]
    if last is None:
        raise ValueError("there are no tokens")
    kept = rows
    if most is not None:
        reached = seen.ends(F.lit(most)).first()
        if reached is not None:
            last, kept = reached["last__"], rows.where(F.col(order) <= reached["last__"])
            cut = F.slice(tokens, F.lit(1), F.lit(int(reached["room__"])))
            kept = kept.withColumn(tokens, F.when(F.col(order) == last, cut).otherwise(F.col(tokens)))
    run = seen.attach(kept, "start").where(n > 0)
    open_ = (F.col(order) == last) & (F.element_at(tokens, -1) != end)
    return run.withColumn(tokens, F.when(open_, F.concat(tokens, F.array(F.lit(end)))).otherwise(F.col(tokens)))


#: Tokens of a stream's chunk, and of the task that chunks meet in.
CHUNK, TASK_TOKENS = 1 << 13, 1 << 24


def stream_windows(rows: DataFrame, tokens: Column | str, order: str, size: int, stride: int = 1, count: str | None = None) -> DataFrame:
    """(idx, window): `size` tokens from every stride-th place of the rows' token
    stream that has as many, across the rows' ends. The stream is cut into chunks that
    also hold the first tokens of the next one; a row gives each chunk that it touches
    its slice, and a chunk is cut into the windows that begin in it. So a token is
    shuffled about once, whatever the windows share, and no group is longer than a
    chunk. Where a column `count` has the number of a row's tokens, tokens are made
    once; if they are an expression, behind the shuffle that gives rows their places."""
    positive(size=size, stride=stride)
    made = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.size(F.coalesce(made, F.array().cast("array<int>"))).cast("long") if count is None else F.col(count)
    rows = rows.select(order, tokens, n.alias("n__")) if isinstance(tokens, str) else rows.withColumn("n__", n)
    seen = totals(rows, "n__", order)
    total = seen.sums().first()
    total = (total["total__"] if total else 0) or 0
    windows = max(0, total - size + stride) // stride
    # places of a chunk's windows, and of a piece's: chunks are cut in two steps, as Spark
    # may copy what a row is cut from for each of its parts
    room = max(CHUNK, 4 * size)
    step = stride * -(-max(size, math.isqrt(room * stride)) // stride)
    room = step * -(-room // step)
    run = seen.attach(rows, "start__").where("n__ > 0").select("start__", "n__", made.alias("tokens__"))
    lo = F.greatest(F.lit(0), F.floor((F.col("start__") - size + 1) / room))
    hi = F.least(F.lit((windows - 1) * stride // room), F.floor((F.col("start__") + F.col("n__") - 1) / room))
    at = run.withColumn("chunk__", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    begin = F.greatest(F.col("chunk__") * room - F.col("start__"), F.lit(0))
    end = F.least((F.col("chunk__") + 1) * room + size - 1 - F.col("start__"), F.col("n__"))
    own = at.where(end > begin).select("chunk__", F.struct("start__", F.slice("tokens__", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part")).alias("own__"))
    tasks = -(-total // TASK_TOKENS)
    own = own.repartition(tasks, "chunk__") if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else own
    chunks = own.groupBy("chunk__").agg(F.sort_array(F.collect_list("own__")).alias("parts__")).select("chunk__", F.flatten("parts__.part").alias("held__"))
    first = (F.col("chunk__") * (room // stride)).cast("long")
    last = F.least(first + (room // stride - 1), F.lit(windows - 1))
    pieces = chunks.select("held__", first.alias("first__"), last.alias("last__"), F.explode(F.sequence(first, last, F.lit(step // stride))).alias("from__"))
    piece = F.slice("held__", ((F.col("from__") - F.col("first__")) * stride + 1).cast("int"), step + size - 1)
    pieces = pieces.select("from__", piece.alias("piece__"), F.least(F.col("from__") + (step // stride - 1), F.col("last__")).alias("to__"))
    cut = pieces.select("from__", "piece__", F.explode(F.sequence("from__", "to__")).alias("idx"))
    return cut.select("idx", F.slice("piece__", ((F.col("idx") - F.col("from__")) * stride + 1).cast("int"), size).alias("window"))


def shifted(window: str) -> tuple[Column, Column]:
    """Inputs and targets of a window: all but its last, all but its first token."""
    n = F.size(window) - 1
    return F.slice(window, 1, n), F.slice(window, 2, n)


def sample_parts(messages: Column, ids: Callable[[Column], Column]) -> Column:
    """(role, ids, header) of each message: its tokens (header, content, newline and,
    for outputs, the end) and how many of them the header has. ids encodes a text."""
    def one(m: Column) -> Column:
        tail = F.when(m["role"].isin(*OUTPUT_ROLES), F.lit(f"\n{EOS}")).otherwise(F.lit("\n"))
        head = ids(F.concat(F.lit("<|"), m["role"], F.lit("|>\n")))
        # contents are encoded by themselves, so that no piece crosses their ends
        return X.let(head, lambda h: F.struct(m["role"].alias("role"), F.concat(h, ids(m["content"]), ids(tail)).alias("ids"), F.size(h).alias("header")))

    return F.transform(messages, one)


def fit_parts(parts: Column, length: int) -> Column:
    """(outcome, parts): kept; compacted to the leading system messages and the
    turns from the last user turn on, if all don't fit length + 1 tokens;
    skipped_system or skipped_overlength if that doesn't fit either."""
    size = lambda p: F.aggregate(p, F.lit(0), lambda a, m: a + F.size(m["ids"]))

    def fit(p: Column) -> Column:
        n = F.size(p)
        other = F.array_position(F.transform(p, lambda m: m["role"] != "system"), True)
        lead = F.when(other > 0, other - 1).otherwise(n).cast("int")

        def choose(lead: Column) -> Column:
            users = F.transform(p, lambda m, i: (m["role"] == "user") & (i >= lead) & (i < n - 1))
            some = F.exists(users, lambda u: u)
            last = (n - F.array_position(F.reverse(users), True) + 1).cast("int")  # one-based
            short = F.concat(F.slice(p, 1, lead), F.slice(p, F.when(some, last).otherwise(n + 1), n))
            outcome = (
                F.when(size(p) <= length + 1, "kept").when(size(F.slice(p, 1, lead)) > length + 1, "skipped_system")
                .when(~some, "skipped_overlength").when(size(short) > length + 1, "skipped_overlength").otherwise("compacted")
            )
            return X.let(outcome, lambda o: F.struct(o.alias("outcome"), F.when(o == "kept", p).when(o == "compacted", short).alias("parts")))

        return X.let(lead, choose)

    return X.let(parts, fit)


def supervised(parts: Column, length: int, pad: int) -> Column:
    """(input_ids, labels), each of `length`: padded, shifted, -100 where nothing is
    trained; outputs' contents, newlines and ends are trained, headers are not."""
    token = F.transform(parts, lambda m: X.let(m["role"].isin(*OUTPUT_ROLES), lambda out: F.transform(m["ids"], lambda t, i: F.struct(t.alias("t"), (out & (i >= m["header"])).alias("on")))))
    filler = F.struct(F.lit(pad).alias("t"), F.lit(False).alias("on"))

    def made(a: Column) -> Column:
        full = F.concat(a, F.array_repeat(filler, F.greatest(F.lit(length + 1) - F.size(a), F.lit(0))))
        ids = F.transform(F.slice(full, 1, length), lambda x: x["t"])
        labels = F.transform(F.slice(full, 2, length), lambda x: F.when(x["on"], x["t"]).otherwise(-100))
        return F.struct(ids.alias("input_ids"), labels.alias("labels"))

    return X.let(F.flatten(token), made)
