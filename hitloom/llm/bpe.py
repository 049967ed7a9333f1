"""BPE encoding and decoding.

Encoder: an Aho-Corasick automaton over the vocabulary finds, for every start in a word, all tokens that
begin there. The longest is tried first; it is taken only if it may follow the token before it, which a
pair-compatibility table answers (would merging the two strings from scratch keep this very border?).
Where no token fits, one token is taken back. Each position is left at most once, so the time is linear
in the word, and the result equals the merge order's result exactly.

Decoder: one blob with the texts of all tokens and a table of offsets into it.

Words are cut at white space first; each distinct word is encoded once per Python process (bounded cache).
Null text counts as empty: no tokens, empty decoded text. Repeated rows are encoded each for themselves. Very long texts and words are
encoded whole. All other columns pass through; one that has a name of the result's is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, map_rows, table

#: Unicode White_Space, as the tokenizer file's \s means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that Python's str.split() takes for white space and the tokenizer does not.
ODD_SPACE = regex.compile("[\\x1c-\\x1f]")
FINAL = 256
PAIRS = 1 << 21


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends", read from path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        splits = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(splits.replace("\\s", SPACE)).findall
        self.space = regex.compile(f"[{SPACE}]+")

        letters, vocab = byte_letters(), model["vocab"]
        surface = lambda t: [letters[c] for c in t.removesuffix(self.suffix)]

        def symbols(token: str) -> str:
            codes = surface(token)
            if token.endswith(self.suffix):
                codes[-1] += FINAL
            return "".join(map(chr, codes))

        # Ranks: the 512 symbols first, then merged tokens in merge order.
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank_id = np.zeros(2 * FINAL + len(merges), dtype=np.uint32)
        by_text: dict[str, int] = {}
        for token, number in vocab.items():
            if len(s := symbols(token)) == 1:
                by_text[s] = ord(s)
                self.rank_id[ord(s)] = number
        self.halves = [(r, r) for r in range(2 * FINAL)]
        self.joined: dict[int, int] = {}
        self.length = [1] * (2 * FINAL)
        for i, (a, b) in enumerate(merges):
            whole, rank = symbols(a + b), 2 * FINAL + i
            left, right = by_text[symbols(a)], by_text[symbols(b)]
            by_text[whole] = rank
            self.rank_id[rank] = vocab[a + b]
            self.halves.append((left, right))
            self.length.append(len(whole))
            self.joined[left * PAIRS + right] = rank
        self.found = ahocorasick.Automaton()
        for s, rank in by_text.items():
            self.found.add_word(s, rank)
        self.found.make_automaton()
        self.pair_table: dict[int, bool] = WordCache(lambda key: self.compatible(*divmod(key, PAIRS)))
        self.word_ids = WordCache(self.encode_word)
        self.piece_ids = WordCache(self.encode_piece)

        # The decoder's offset table.
        texts = {number: token for token, number in vocab.items()} | {n: s for s, n in self.special.items()}
        parts = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Would merging the joined strings leave the border between these two tokens standing?

        Both tokens are undone step by step, latest merge first. The border falls if at some moment the two
        neighbours at the border could have merged before the step that made the present pair.
        """
        limit, halves, joined = 1 << 60, self.halves, self.joined
        while True:
            made = joined.get(left * PAIRS + right)
            if made is not None and made < limit:
                return False
            left_whole, right_whole = halves[left][0] == left, halves[right][0] == right
            if left_whole and right_whole:
                return True
            if right_whole or (not left_whole and left > right):
                limit, left = left, halves[left][1]
            else:
                limit, right = right + 1, halves[right][0]

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        word = data[:-1].decode("latin-1") + chr(data[-1] + FINAL)
        size, starts, length = len(word), {}, self.length
        for end, rank in self.found.iter(word):
            starts.setdefault(end + 1 - length[rank], []).append(rank)  # grows with the end: the longest comes last
        at, taken, dead = 0, [], set()
        tries = list(starts.get(0, ()))
        stack = []
        while at < size:
            while tries:
                rank = tries.pop()
                end = at + length[rank]
                if end not in dead and (not taken or self.pair_table[taken[-1] * PAIRS + rank]):
                    stack.append((at, tries))
                    taken.append(rank)
                    at, tries = end, list(starts.get(end, ()))
                    break
            else:
                dead.add(at)
                at, tries = stack.pop()
                taken.pop()
        return self.rank_id[taken].tobytes()

    def encode_word(self, word: str) -> bytes:
        if word.isalpha() and "'" not in word:
            return self.piece_ids[word]
        return b"".join([self.piece_ids[p] for p in self.pieces(word)])

    def encode_plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case by character: str.lower() would look at a final sigma's neighbours.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        words = self.space.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.word_ids.__getitem__, filter(None, words)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text or not self.special_at.search(text):
            return self.encode_plain(text)
        out, at = [], 0
        for hit in self.special_at.finditer(text):
            out += [self.encode_plain(text[at : hit.start()]), np.uint32(self.special[hit[0]]).tobytes()]
            at = hit.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: bytes | None, step: int = 1 << 16) -> str:
        if not ids:
            return ""
        every, out = np.frombuffer(ids, dtype=np.uint32), []
        for at in range(0, len(every), step):
            some = every[at : at + step].astype(np.int64)
            first, size = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(size)
            place = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
            out.append(self.blob[place].tobytes())
        return b"".join(out)[:-1].decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ids (binary: little-endian unsigned 32-bit token ids of the whole text; empty for null)."""
    return map_rows(df, [text], {ids: "binary"}, lambda: (lambda texts, code=word_bpe(path).encode: [[code(t) for t in texts]]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of binary token ids (empty for null)."""
    return map_rows(df, [ids], {text: "string"}, lambda: (lambda rows, text_of=word_bpe(path).decode: [[text_of(r) for r in rows]]))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return decode(coded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe_roundtrip": op1_bpe_roundtrip}
