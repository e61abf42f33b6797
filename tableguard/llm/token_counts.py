"""Token counts by a unigram model, with forward scores shared over a trie.

Texts are cut into pre-tokens; a pre-token is split into pieces of a fixed
vocabulary so that the sum of log probabilities is largest (ties: fewer
pieces). The distinct new pre-tokens of about ``TOGETHER`` are inserted in a trie,
which is walked in byte order: the forward score of a prefix is computed once
for all pre-tokens that begin with it, and a terminal stores the count of pieces.
Texts hold numbers of terminals, whose counts are then added up.

The vocabulary is never trained here. Its file lists byte pieces by rank, and
a piece's probability follows from its rank by Zipf's law; all 256 single bytes
are pieces, so every text has a split. The file is read on the driver, and the
vocabulary, whose size the file fixes, is broadcast. Texts are not shuffled.
Terminals are kept between batches, up to a bound that limits memory only.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOGETHER = 1 << 21
KEPT = 1 << 19


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Log probability of each piece, from its rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


def endings(pieces) -> set[bytes]:
    """All that a piece ends with: what is not among them cannot be the end of a longer piece."""
    return {p[k:] for p in pieces for k in range(len(p))}


def trie_counts(tokens, pieces: dict[bytes, float], ends: set[bytes]) -> dict[str, tuple[int, float]]:
    """(pieces, log probability) of the best split of each distinct pre-token.

    In byte order the trie is walked depth first: ``score`` and ``count`` hold
    the path from the root, and a new pre-token goes on from where it leaves
    its predecessor.
    """
    out, score, count, last = {}, [0.0], [0], b""
    find = pieces.get
    for word, token in sorted((t.encode("utf-8", "surrogatepass"), t) for t in tokens):
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best, fewest = -math.inf, 0
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                p = find(piece)
                if p is not None:
                    s, c = score[start] + p, count[start] + 1
                    if s > best or s == best and c < fewest:
                        best, fewest = s, c
                elif piece not in ends:
                    break
            score.append(best)
            count.append(fewest)
        out[token] = count[-1], score[-1]
        last = word
    return out


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens, n_pretokens, log_prob) of each row.

    A null text counts as an empty one: no tokens, log probability 0. Rows with
    null or repeated keys are counted like others, and texts of any length
    whole. Other columns take no part; no rows, no rows.
    """
    pieces = read_vocabulary(vocabulary)
    missing = [b for b in range(256) if bytes([b]) not in pieces]
    if missing:
        raise ValueError(f"{vocabulary}: bytes without a piece: {missing}")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        import pyarrow as pa
        import regex

        cut, ends = regex.compile(pattern).findall, endings(sent.value)

        def numbering():
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, np.zeros(0, dtype=np.int64), np.zeros(0)

        numbers, counts, logs = numbering()
        for b in batches:
            texts, first, rows, held = b.column(1), 0, [], 0
            for at in range(b.num_rows):
                found = cut(texts[at].as_py() or "")
                rows.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                held += len(found)
                if held < TOGETHER and at + 1 < b.num_rows:
                    continue
                new = list(islice(numbers, len(counts), None))
                split = trie_counts(new, sent.value, ends)
                counts = np.append(counts, np.array([split[t][0] for t in new], dtype=np.int64))
                logs = np.append(logs, np.array([split[t][1] for t in new], dtype=np.float64))
                columns = [b.column(0).slice(first, len(rows)), pa.array([int(counts[r].sum()) for r in rows], pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([float(logs[r].sum()) for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "n_pretokens", "log_prob"])
                first, rows, held = at + 1, [], 0
                if len(numbers) > KEPT:
                    numbers.default_factory = None  # else the numbering keeps itself alive
                    numbers, counts, logs = numbering()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_pretokens long, log_prob double")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return count_tokens(table(spark, sf_dir, "documents"))
