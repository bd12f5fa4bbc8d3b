"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

For each prefix of a word, BPE ends in one last token: the token that is a suffix of the prefix and that no merge
joins to the last token of what stands before it. The distinct words of a batch are visited in sorted order, which
is the depth-first order of their trie; the last tokens along the path are kept, so a prefix that several words
share is worked on once. Which tokens a prefix ends with is read off an automaton of the vocabulary (each state is the
longest end of the prefix that begins a token, and knows the tokens among its ends, longest first), whose state is kept
along the path too. Walking back over the last tokens gives a word's ids. Known words are looked up (CACHE at most
and those of the texts at hand; then only the latter stay).

The vocabulary file's path is a parameter; the driver reads it and sends it to the workers. A file that asks for
anything else than byte-level BPE with the usual split is refused (`check`), not encoded wrongly. Null texts are empty:
no tokens. The added tokens' strings in a text are those tokens, as the file's own library takes them by default.
Texts are encoded whole; repeated rows each; no rows give no rows. Only doc_id and text are read, whatever other
columns are called.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import prepare

CACHE, PAIRS, BATCH = 500_000, 1_200_000, 1 << 20
FAR = 1 << 60
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
# Fixed value: how byte-level BPE vocabularies split a text.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check(file: dict) -> None:
    """Raises ValueError for a tokenizer file that this encoder doesn't follow. Truncation and padding are never used."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    wrong = []
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        wrong.append("model")
    if file.get("normalizer"):
        wrong.append("normalizer")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (file.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    if any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"tokenizer file with unsupported settings: {', '.join(wrong)}")


class Bpe:
    def __init__(self, source: str):
        file = json.loads(source)
        check(file)
        known, model = _alphabet(), file["model"]
        raw = lambda t: bytes(known[c] for c in t)
        self.split = regex.compile(PATTERN)
        self.id = {raw(t): k for t, k in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = {k: b for b, k in self.id.items()} | {k: t.encode() for t, k in self.special.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for k, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            pair = self.id[a], self.id[b]
            self.rank[pair] = k
            self.made.setdefault(self.id[a + b], (*pair, k))
        #: Whether a token's own bytes are encoded as that token; None: not known yet.
        self.whole: list[bool | None] = [None] * (max(self.id.values()) + 1)
        self._automaton()
        self.joins: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.words: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """States are beginnings of tokens: go (state, byte), the state of the longest end, length, and the states of the tokens a state ends with."""
        go: dict[int, int] = {}
        length, token = [0], [-1]
        for x, k in self.id.items():
            state = 0
            for byte in x:
                new = go.get(state << 8 | byte)
                if new is None:
                    new = go[state << 8 | byte] = len(length)
                    length.append(length[state] + 1)
                    token.append(-1)
                state = new
            token[state] = k
        fall, first, more = [0] * len(length), [0] * len(length), [0] * len(length)
        for key, new in sorted(go.items(), key=lambda e: length[e[1]]):
            state, byte = key >> 8, key & 255
            if state:
                s = fall[state]
                while (to := go.get(s << 8 | byte)) is None and s:
                    s = fall[s]
                fall[new] = to or 0
            more[new] = first[fall[new]]
            first[new] = new if token[new] >= 0 else more[new]
        self.go, self.fall, self.length, self.token, self.first, self.more = go, fall, length, token, first, more

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is made) along the token's left (0) or right (1) edge, from the byte up."""
        if (found := self.edges.get((token, side))) is None:
            found, t = [], token
            while t in self.made:
                found.append((t, self.made[t][2]))
                t = self.made[t][side]
            found = self.edges[token, side] = [*found, (t, -1)][::-1]
        return found

    def stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between tokens a and b."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            here = self.rank.get((left[i][0], right[j][0]), FAR)
            up = left[i + 1][1] if i + 1 < len(left) else FAR
            up2 = right[j + 1][1] if j + 1 < len(right) else FAR
            if here < FAR and here < up and here <= up2:  # of equal pairs the left one merges first
                return False
            if up == up2 == FAR:
                return True
            if up <= up2:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of distinct words into the table."""
        if len(self.joins) > PAIRS:
            self.joins.clear()
        known, whole = self.joins, self.whole
        go, fall, length, tokens, first, more = self.go.get, self.fall, self.length, self.token, self.first, self.more
        before, last, size, states = b"", [-1], [0], [0]  # of each prefix of the path: its last token, that token's length, the automaton's state
        for word, text in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for end in range(shared + 1, len(word) + 1):
                byte = word[end - 1]
                while (to := go(state << 8 | byte)) is None and state:
                    state = fall[state]
                state = to or 0
                states.append(state)
                found = first[state]
                while True:  # every byte is a token, so one fits
                    token = tokens[found]
                    at = end - length[found]
                    if at:
                        pair = last[at] << 24 | token
                        fits = known.get(pair)
                        if fits is None:
                            fits = known[pair] = self.stays(last[at], token)
                    else:
                        fits = whole[token]
                        if fits is None:
                            fits = whole[token] = self._whole(token)
                    if fits:
                        break
                    found = more[found]
                last.append(token)
                size.append(end - at)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            made = array("I", ids)
            if sys.byteorder == "big":
                made.byteswap()
            self.words[text] = made.tobytes()
            before = word

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        return token not in self.made or not self.stays(self.made[token][0], self.made[token][1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        parts = []
        for t in texts:
            if any(x in t for x in self.special) and (cuts := list(self.marks.finditer(t))):
                edge = [0, *(x for m in cuts for x in m.span()), len(t)]
                own = [self.split.findall(t[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                parts.append((own, [m[0] for m in cuts]))
            else:
                parts.append(([self.split.findall(t)], []))
        wanted = set().union(*(w for own, _ in parts for w in own))
        missing = wanted - self.words.keys()
        if missing:
            if len(self.words) + len(missing) > CACHE:
                # The words of these texts stay, and with them the frequent ones.
                self.words = {w: self.words[w] for w in wanted - missing}
            self.encode_words(list(missing))
        get = self.words.__getitem__
        out = []
        for own, marks in parts:
            ids = [b"".join(map(get, w)) for w in own]
            for k, m in enumerate(marks):
                ids[k] += np.array([self.special[m]], "<u4").tobytes()
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text): n_tokens, ids (array), decoded, and the hashes of both."""
    return _run(docs, path, True)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text): n_tokens and the hashes of ids and decoded text."""
    return _run(docs, path, False)


def _run(docs: DataFrame, path: str, full: bool) -> DataFrame:
    prepare(docs.sparkSession)
    source = Path(path).read_text(encoding="utf-8")
    check(json.loads(source))
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches):
        source = shared.value
        if (key := hash(source)) not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Bpe(source)
        bpe = _LOADED[key]
        for batch in batches:
            n, sha, sha2, all_ids, decoded = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (held < BATCH or stop == at):
                    held += len(texts[stop] or "")
                    stop += 1
                for ids in bpe.encode([x or "" for x in texts[at:stop]]):
                    back = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    sha2.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if full:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        decoded.append(back)
                at = stop
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(sha2, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
