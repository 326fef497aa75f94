"""Token ids of a public vocabulary, quickly and exactly as the library gives them.

word_bpe_49k.json lower-cases, drops white space, cuts by a pattern and merges inside each cut. For texts of plain
ASCII and Latin-1 letters the cuts are made here and each distinct cut is encoded once by the library's own model;
any other text goes to the library whole. Other vocabularies always go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Distinct cuts that a worker remembers; rarer ones are encoded again when they come.
REMEMBERED = 500_000

# Fixed values of the vocabulary file: its pattern, here for lower-case ASCII and Latin-1 letters only.
_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
_WORD_END = "</w>"


def vocabulary_path(name: str) -> str:
    """A file, or the name of a public vocabulary."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """encode(text): ids as little-endian 32-bit bytes; library(text): the library's encoding, with offsets."""

    def __init__(self, name: str = WORD_BPE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        path = vocabulary_path(name)
        self.drops_space = self.pieces = False
        self.known: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.drops_space = kinds == ["NFC", "Replace", "Lowercase"] and split == _PATTERN and spec["model"].get("end_of_word_suffix") == _WORD_END
        if self.drops_space:
            self.merge = Tokenizer(self.full.model)
            self.merge.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocab = self.full.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(_WORD_END)]] = True
            self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items() if b != 0x20})
            self.longest_special = max([len(x["content"]) for x in spec["added_tokens"]], default=0)

    def _learn(self, cuts: list[str], into: dict[str, bytes]) -> None:
        text = " ".join(cuts).encode().decode("latin1").translate(self.letters)
        ids = np.array(self.merge.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(cuts):
            raise AssertionError("each cut must end in one word end")
        data, at = ids.tobytes(), 0
        for cut, end in zip(cuts, (ends * 4).tolist()):
            into[cut] = data[at:end]
            at = end

    def _parts(self, text: str) -> list[bytes]:
        cuts = _CUTS.findall(text.lower())
        known = self.known
        try:
            return list(map(known.__getitem__, cuts))
        except KeyError:
            new = list(set(cuts).difference(known))
            if len(known) + len(new) > REMEMBERED:
                known = {x: known[x] for x in set(cuts) if x in known}
            self._learn(new, known)
            return list(map(known.__getitem__, cuts))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.pieces:
            return np.array(self.pieces.encode(text), "<u4").tobytes()
        if self.drops_space and not _UNUSUAL.search(text):
            return b"".join(self._parts(text))
        return np.array(self.full.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def library(self, text: str):
        return self.full.encode(text, add_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
