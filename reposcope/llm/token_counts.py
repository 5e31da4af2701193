"""Token counts by a sentencepiece model, with a whole-token shortcut.

Offline, once per Python worker, the vocabulary is proved to allow the
shortcut: the model is a BPE model without text normalisation, and no piece
joins a word to a following word mark. No merge can then cross the start of a
word, so a text's tokens are the tokens of its pre-tokens, one after another.
A vocabulary string that encodes alone as its own single token is counted as
one without merging; only the other pre-tokens go through the library's
merges, once per worker while they stay in a bounded cache. A model for which
the proof fails is given whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE = 200_000  # pre-tokens kept per worker
LONG = 64  # longer pre-tokens are not kept
_SLOW = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


class PieceCounter(dict):
    """Tokens of a pre-token, by key.

    Keys: ``word`` stands for mark + word, ``\\nword`` for a line break and a
    word without mark, ``''`` for a lone mark. Keys that start with the mark
    are runs of two or more marks with what follows.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proved = self._prove()
        if self.proved:
            self._preload()

    def _prove(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        norm = model.normalizer_spec
        plain = (model.trainer_spec.model_type == pb.TrainerSpec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
                 and not norm.precompiled_charsmap and not norm.normalization_rule_tsv and norm.add_dummy_prefix
                 and not norm.remove_extra_whitespaces and norm.escape_whitespaces)
        types = model.ModelProto.SentencePiece if hasattr(model, "ModelProto") else pb.ModelProto.SentencePiece
        crossing = re.compile(f"[^{MARK}]{MARK}")
        return plain and not any(p.type == types.USER_DEFINED or crossing.search(p.piece) or "\n" in p.piece for p in model.pieces)

    def _preload(self) -> None:
        """Vocabulary strings that the library encodes as one token, with a word mark before and after a line break."""
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        marked = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        inner = ["\n" + p for p in pieces if MARK not in p]
        for words, extra in ((marked, 0), (inner, 2)):
            for word, ids in zip(words, self.sp.encode(words, num_threads=1)):
                if len(ids) == 1 + extra:
                    dict.__setitem__(self, word, 1 if not extra else 2)
        self[""], self["\n"] = 1, 1
        self.alone = dict(self)

    def __missing__(self, key: str) -> int:
        if key[0] == "\n":  # the library puts a lone mark before the line break
            n = len(self.sp.encode(key)) - 1
        else:  # and a mark before all else
            n = len(self.sp.encode(key[1:] if key[0] == MARK else key))
        if len(key) <= LONG:
            if len(self) > CACHE + len(self.alone):
                self.clear()
                self.update(self.alone)
            self[key] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.proved:
            return len(self.sp.encode(text))
        if "  " in text or text[0] == " " or MARK in text:
            keys = _SLOW.findall(MARK + text.replace(" ", MARK))
            # One mark before a word is what a plain key means.
            keys = [k[1:] if k[0] == MARK and (len(k) == 1 or k[1] != MARK) else k for k in keys]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return sum(map(self.__getitem__, keys))


_COUNTERS: dict[str, PieceCounter] = {}


def model_path(name_or_path: str) -> str:
    """A file path as given; a bare name is looked up among the installed public tokenizers (on each executor)."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def counter(model: str) -> PieceCounter:
    if model not in _COUNTERS:
        _COUNTERS[model] = PieceCounter(model_path(model))
    return _COUNTERS[model]


def token_count_udf(model: str):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for s in texts:
            yield pd.Series([c.count(t) if isinstance(t, str) else 0 for t in s], dtype="int64")
    return count


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    One row per input row, no shuffle. A null text counts as empty (0 bytes,
    0 tokens); no begin, end or special tokens are added, strings that look
    like them are ordinary text. Other columns are ignored.
    """
    n = token_count_udf(model)(F.col("_text"))
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .withColumn("n_tokens", n)
            .select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
