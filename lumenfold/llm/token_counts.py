"""Token counts under a unigram vocabulary by dynamic programming on a trie.

A text's pre-tokens are its words, each led by the word mark. The distinct pre-tokens of a task go into a trie. A node's
forward score, the best sum of piece scores over segmentations of its prefix, and the number of pieces of that best
segmentation, depend on its prefix only: they are computed once, from its ancestors, when the node is made, and are shared
by all pre-tokens that continue it. The end of a pre-token stores its count. A text's count is the sum over its words.

The vocabulary is a sentencepiece model file; its pieces are ordered by frequency of use, so piece r of n has the Zipf score
-ln(r + 2). A character outside the vocabulary falls back to its UTF-8 bytes, one token each. Of segmentations of equal
score the one with fewer tokens counts.

Work is text by text in Arrow batches: no shuffle. A task's trie is dropped and begun anew beyond MAX_NODES nodes, which
bounds memory and changes no result.

Defined results: null and empty texts have no tokens; repeated documents are counted row by row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.runtime import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_NODES = 1_000_000
#: Score of each byte of a character that no piece covers.
BYTE_SCORE = -20.0


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(plain)}


class Pieces:
    """Automaton over the pieces: after each character, the pieces that end there."""

    def __init__(self, scores: dict[str, float]):
        self.step: dict[int, int] = {}
        self.fail, self.ending = [0], [()]
        step, fail, ending, letters = self.step, self.fail, self.ending, [[]]
        for piece, score in scores.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if (after := step.get(key)) is None:
                    after = step[key] = len(fail)
                    fail.append(0)
                    ending.append(())
                    letters.append([])
                    letters[node].append((ord(c), after))
                node = after
            ending[node] = ((len(piece), score),)
        queue = [n for _, n in letters[0]]
        for node in queue:
            for code, after in letters[node]:
                queue.append(after)
                fail[after] = self.after(fail[node], code)
            ending[node] += ending[fail[node]]

    def after(self, state: int, code: int) -> int:
        """The state after a further character; found once, then remembered."""
        key = state << 21 | code
        found = self.step.get(key)
        if found is None:
            found = self.step[key] = self.after(self.fail[state], code) if state else 0
        return found


class Trie:
    """Pre-tokens, with forward scores by node. Node 0 is the empty prefix."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens, self.state = array("d", [0.0]), array("q", [0]), array("i", [0])

    def insert(self, word: str) -> int:
        """The number of tokens of word."""
        child, best, tokens, state = self.child, self.best, self.tokens, self.state
        known, find, ending = self.pieces.step, self.pieces.after, self.pieces.ending
        path, node = [0], 0
        for depth, c in enumerate(word, 1):
            code = ord(c)
            after = child.get(key := node << 21 | code)
            if after is None:
                at = known.get(state[node] << 21 | code)
                if at is None:
                    at = find(state[node], code)
                top = None
                for n, score in ending[at]:
                    back = path[depth - n]
                    score += best[back]
                    if top is None or score > top or (score == top and tokens[back] < fewest):
                        top, fewest = score, tokens[back] + 1
                if top is None or 1 not in [n for n, _ in ending[at][-1:]]:  # no piece is the character alone
                    n = len(c.encode())
                    if top is None or best[node] + n * BYTE_SCORE > top:
                        top, fewest = best[node] + n * BYTE_SCORE, tokens[node] + n
                after = child[key] = len(best)
                best.append(top)
                tokens.append(fewest)
                state.append(at)
            node = after
            path.append(node)
        return tokens[node]


_built: dict[str, Pieces] = {}


def _pieces(path: str, scores) -> Pieces:
    """The automaton of a vocabulary's broadcast scores, made once by each worker."""
    if path not in _built:
        _built[path] = Pieces(scores.value)
    return _built[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_bytes of each row. Only the driver reads the file at path; its pieces, about a megabyte, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie, ends = Trie(_pieces(path, shared)), {}
        for batch in batches:
            words, tokens, size = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                text = text.as_py() or b""
                own = text.split()
                for w in set(own).difference(ends):
                    ends[w] = trie.insert(MARK + w.decode())
                words.append(len(own))
                tokens.append(sum(map(ends.__getitem__, own)))
                size.append(len(text))
                if len(trie.best) > MAX_NODES:
                    trie.reset()
                    ends = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, size))], ["doc_id", "n_words", "n_tokens", "n_bytes"])

    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint, n_bytes bigint")


def op7_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_tokens and n_bytes of every document."""
    return token_counts(docs)
