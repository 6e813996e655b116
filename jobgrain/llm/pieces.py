"""SentencePiece encoding and decoding with the N best segmentations of a text.

The lattice of a text has an edge for every vocabulary piece that matches somewhere.
Viterbi scores from the front are exact estimates of the way still to go for an A*
search from the back, so paths come out best first. No piece reaches over the start
of a word, hence the lattice falls into one part per word: the best path is found
per distinct word, and the search runs only in the few words whose second-best path
loses least, since no other word can take part in the N best.
"""

import hashlib
import heapq
import re
from itertools import chain, count

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
# Stands for a word mark that is in the text itself; no valid text holds it.
MARK = "\udfff"
# Stands for a byte that is only a part of a character.
HIGH = "\uffff"
UNKNOWN_PENALTY = 10.0
LOWEST = float("-inf")
STOP = ()
# Words remembered per worker process and generation; two generations are kept.
REMEMBERED = 300_000
ENCODED = ("n_pieces int, score double, ids array<int>, "
           "others array<struct<score:double, edits:array<struct<at:int, gone:int, ids:array<int>>>>>, round_trip boolean")

_models: dict[str, "Model"] = {}


class Model:
    """Pieces and scores of a vocabulary with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], bytes_from: int):
        self.pieces, self.bytes_from = pieces, bytes_from
        self.known = {p: (i, s) for i, (p, s, ok) in enumerate(zip(pieces, scores, plain)) if ok}
        # Every piece with its id and score, and every front part of a piece with None.
        self.front = {p[:i]: None for p in self.known for i in range(1, len(p))} | self.known
        self.alone = frozenset(p for p in self.known if len(p) == 1)
        self.matcher = ahocorasick.Automaton()
        for p, (i, x) in self.known.items():
            self.matcher.add_word(p, (len(p), x, (i,)))
        self.matcher.make_automaton()
        self.shown = [p.replace(SPACE, " ") for p in pieces]
        self.shown[bytes_from:bytes_from + 256] = [chr(b) if b < 128 else HIGH for b in range(256)]
        usual = [s for _, s in self.known.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.words = self._cuts()
        self.young, self.old, self.searched, self.losses = {}, {}, {}, {}

    @classmethod
    def load(cls, path: str) -> tuple:
        """What __init__ takes, read from a model file."""
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        plain = [not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)) for i in ids]
        return [p.id_to_piece(i) for i in ids], [p.get_score(i) for i in ids], plain, p.piece_to_id("<0x00>")

    def _cuts(self) -> re.Pattern:
        """What cuts a text where no piece can reach over: at word marks, at characters of their own, and before
        a mark of punctuation if no piece has it behind the character before."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known):
            return re.compile(".+", re.S)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.known))
        ends = ".,;:!?"
        bound = re.escape("".join(sorted({a for p in self.known for a, b in zip(p, p[1:]) if b in ends} - {SPACE})))
        words = f"{SPACE}*[^{SPACE}{alone}{ends}{bound}]++(?=[{ends}])|{SPACE}*[^{SPACE}{alone}]+"
        return re.compile((f"[{alone}]|" if alone else "") + f"{words}|{SPACE}+", re.S)

    def _as_bytes(self, character: str) -> tuple[int, ...]:
        """Byte pieces of a character that is no piece."""
        return tuple(self.bytes_from + b for b in (SPACE if character == MARK else character).encode("utf-8", "surrogatepass"))

    def edges(self, word: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, score, ids) of the pieces in `word` by start; an unknown character is its bytes."""
        found, front, size = [], self.front, len(word)
        for start in range(size):
            end = start + 1
            piece = word[start]
            hit = front.get(piece, STOP)
            if not hit:
                found.append((start, end, self.unknown, self._as_bytes(piece)))
            while hit is not STOP:
                if hit:
                    found.append((start, end, hit[1], (hit[0],)))
                end += 1
                if end > size:
                    break
                hit = front.get(word[start:end], STOP)
        return found

    def best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best path of a word, and what its second-best path loses."""
        hit = self.old.get(word) or self._best(word)
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = hit
        return hit

    def _best(self, word: str) -> tuple[float, tuple[int, ...], float]:
        size = len(word)
        # By the last character of a piece; the last place, -1, is the front of the word.
        best, into = [LOWEST] * size + [0.0], [None] * size
        second = [LOWEST] * size  # of the ways to a place, the one behind the best
        for last, edge in self._by_end(word):
            n, x, _ = edge
            x += best[last - n]
            if x > best[last]:
                second[last] = best[last]
                best[last] = x
                into[last] = edge
            elif x > second[last]:
                second[last] = x
        at, parts, loss = size - 1, [], -LOWEST
        while at >= 0:  # the second-best path leaves the best one for good at one of its places
            less = best[at] - second[at]
            if less < loss:
                loss = less
            n, _, ids = into[at]
            parts.append(ids)
            at -= n
        parts.reverse()
        return best[size - 1], tuple(chain.from_iterable(parts)), loss

    def loss(self, word: str) -> float:
        """What the second-best path of a word loses, summed over whole paths: tells losses apart that are nearly equal."""
        hit = self.losses.get(word)
        if hit is not None:
            return hit
        size, found = len(word), list(self._by_end(word))
        best, into = [LOWEST] * size + [0.0], [None] * size
        for last, edge in found:
            way = best[last - edge[0]] + edge[1]
            if way > best[last]:
                best[last], into[last] = way, edge
        at, on = size - 1, [None] * size
        while at >= 0:
            on[at] = into[at]
            at -= into[at][0]
        rest, second = [LOWEST] * (size + 1), LOWEST
        rest[size - 1] = 0.0
        for last, edge in reversed(found):
            x, start = edge[1] + rest[last], last - edge[0]
            rest[start] = max(rest[start], x)
            if on[last] is not edge:
                second = max(second, x + best[start])
        hit = best[size - 1] - second
        if len(self.losses) >= REMEMBERED // 4:
            self.losses.clear()
        if size <= 64:
            self.losses[word] = hit
        return hit

    def _by_end(self, word: str):
        """(place of the last character, (length, score, ids)) of the edges of a word by end: found in one pass if each
        of its characters is a piece."""
        if self.alone.issuperset(word):
            return self.matcher.iter(word)
        return [(end - 1, (end - start, x, ids)) for start, end, x, ids in sorted(self.edges(word), key=lambda e: (e[1], e[0]))]

    def _close(self, words: list[str], losses: tuple[float, ...], n: int) -> list[int]:
        """Places of the n words that lose least, the first ones of equal losses, in order of place."""
        left, low = list(losses), LOWEST
        for _ in range(min(n, len(left))):
            low = min(left)
            left[left.index(low)] = -LOWEST
        near = [i for i, x in enumerate(losses) if x <= low + 1e-6]
        if len(near) > n:
            near = [i for _, i in heapq.nsmallest(n, [(self.loss(words[i]), i) for i in near])]
        return sorted(near)

    def paths(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a word, best first: A* from its end, the front scores being exact estimates.

        A way is a piece and the way behind it, so ids are put together once, at the front. No place is left
        more than n times: each of the n best paths goes on from it by one of the n best ways behind it.
        """
        if (word, n) in self.searched:
            return self.searched[word, n]
        size = len(word)
        best, into = [0.0] + [LOWEST] * size, [[] for _ in range(size + 1)]
        for edge in self.edges(word):
            into[edge[1]].append(edge)
            best[edge[1]] = max(best[edge[1]], best[edge[0]] + edge[2])
        order, out, left = count(), [], [0] * (size + 1)
        heap = [(-best[-1], next(order), size, 0.0, None)]
        while heap and len(out) < n:
            _, _, at, score, way = heapq.heappop(heap)
            if at == 0:
                ids = []
                while way:
                    piece, way = way
                    ids.extend(piece)
                out.append((score, tuple(ids)))
                continue
            if left[at] == n:
                continue
            left[at] += 1
            for s, _, x, piece in into[at]:
                heapq.heappush(heap, (-(best[s] + x + score), next(order), s, score + x, (piece, way)))
        if len(self.searched) >= REMEMBERED // 4:
            self.searched.clear()
        if size <= 64:
            self.searched[word, n] = out
        return out

    def encode(self, text: str, n: int = N_BEST) -> tuple[float, list[int], list[tuple[float, list[tuple[int, int, tuple]]]]]:
        """Score and ids of the best segmentation, and the next n - 1 as (score, edits of the best ids)."""
        if not text:
            return 0.0, [], []
        words = self.words.findall(SPACE + text.replace(SPACE, MARK).replace(" ", SPACE))
        known, best = self.young.get, self.best
        parts = [known(w) or best(w) for w in words]
        scores, pieces, losses = zip(*parts)
        total = sum(scores)
        ids = list(chain.from_iterable(pieces))
        if n < 2:
            return total, ids, []
        close = self._close(words, losses, n - 1)
        choices = [self.paths(words[i], n) for i in close]
        at, before, starts = 0, 0, {}
        for i in close:
            at += sum(map(len, pieces[before:i]))
            before, starts[i] = i, at
        order, out = count(), []
        heap = [(-total, next(order), len(close), 0.0, ())]
        while heap and len(out) < n:  # the same search over whole words: what lies in front is at its best
            low, _, left, lost, edits = heapq.heappop(heap)
            if left == 0:
                out.append((total + lost, list(edits)))
                continue
            i, mine = close[left - 1], choices[left - 1]
            for score, other in mine:
                less = score - mine[0][0]
                edit = () if other == parts[i][1] else ((starts[i], len(parts[i][1]), other),)
                heapq.heappush(heap, (-(total + lost + less), next(order), left - 1, lost + less, edit + edits))
        return total, ids, [x for x in out if x[1]][:n - 1]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; runs of byte pieces are UTF-8."""
        shown = self.shown
        text = "".join([shown[i] for i in ids])
        if HIGH not in text:
            return text[1:] if text[:1] == " " and self.pieces[ids[0]][:1] == SPACE else text
        low, out, raw = self.bytes_from, [], bytearray()
        for i in ids:
            if low <= i < low + 256:
                raw.append(i - low)
                continue
            if raw:
                out.append((True, raw.decode("utf-8", "replace")))
                raw = bytearray()
            out.append((False, self.pieces[i]))
        if raw:
            out.append((True, raw.decode("utf-8", "replace")))
        text = "".join(t if is_raw else t.replace(SPACE, " ") for is_raw, t in out)
        return text[1:] if out and not out[0][0] and text.startswith(" ") else text


def _model_of(shared, key: str) -> Model:
    """The model of this worker process, made once."""
    if key not in _models:
        _models.clear()
        _models[key] = Model(*shared.value)
    return _models[key]


def _shared(spark: SparkSession, path: str):
    """The vocabulary, read on the driver and broadcast: as many pieces as the model has."""
    parts = Model.load(path)
    return spark.sparkContext.broadcast(parts), hashlib.sha256(repr(parts).encode("utf-8", "replace")).hexdigest()


def encoded(spark: SparkSession, text: Column, path: str = MODEL, n: int = N_BEST) -> Column:
    """A struct of n_pieces, score, ids, others and round_trip for a text column."""
    shared, key = _shared(spark, path)

    @F.pandas_udf(ENCODED)
    def run(texts: pd.Series) -> pd.DataFrame:
        model, rows = _model_of(shared, key), []
        for text in texts:
            score, ids, others = model.encode(text or "", n)
            edits = [{"score": s, "edits": [{"at": a, "gone": g, "ids": list(i)} for a, g, i in e]} for s, e in others]
            rows.append((len(ids), score, ids, edits, model.decode(ids) == (text or "")))
        return pd.DataFrame(rows, columns=["n_pieces", "score", "ids", "others", "round_trip"])

    return run(text)


def encode(docs: DataFrame, path: str = MODEL, n: int = N_BEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and the N best segmentations of every whole text.

    `ids` are the pieces of the best one, `others` the next ones in falling order of
    score, each as edits of `ids`: at position `at`, `gone` ids are replaced by `ids`.
    `round_trip` tells whether decoding gives back the text; it does for every text.
    A null or empty text has no pieces and no other segmentation. Texts with fewer
    segmentations than n return those they have; equal scores come in a fixed order.
    Rows are independent, so repeated rows give equal rows; extra columns are not
    looked at; an empty table gives an empty result.
    """
    return docs.select(F.col(key), encoded(docs.sparkSession, F.col(text), path, n).alias("e")).select(key, "e.*")


def decode(df: DataFrame, path: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with `text` decoded from the ids; null ids give ''."""
    shared, key = _shared(df.sparkSession, path)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        model = _model_of(shared, key)
        return pd.Series([model.decode(x if x is not None else ()) for x in lists], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def applied(ids: Column, edits: Column) -> Column:
    """`ids` with the edits of one other segmentation made, last one first."""
    return F.aggregate(F.reverse(edits), ids, lambda acc, e: F.concat(
        F.slice(acc, 1, e["at"]), e["ids"], F.slice(acc, e["at"] + e["gone"] + 1, F.size(acc))))
