"""Features of the sequence model: listed lines and their contexts of both texts of a change, as padded ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.cluster import checkpointed
from faultline.functions import contexts as C
from faultline.functions.text import tokenize_code
from faultline.operators import vocab

COLUMNS = ("old_lines", "new_lines", "old_context", "new_context")


def shared_vocabulary(train: DataFrame, key: str, columns: list[str], max_vocab: int = vocab.MAX_VOCAB) -> DataFrame:
    """One vocabulary over several text columns; the tokens of a row's first column come first."""
    tokens = F.concat(*[tokenize_code(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return vocab.fit_vocabulary(train.select(key, tokens.alias("__tokens")), key, "__tokens", max_vocab)


def sequence_features(functions: DataFrame, key: str, old: str, new: str, old_numbers: str, new_numbers: str) -> DataFrame:
    """``functions`` plus ``<column>_feature`` of COLUMNS; the vocabulary is fitted once, on training rows."""
    found = checkpointed(shared_vocabulary(functions.filter("partition = 'train'"), key, [old, new]))
    texts = {}
    for side, code, numbers in (("old", F.col(old), F.col(old_numbers)), ("new", F.col(new), F.col(new_numbers))):
        texts[f"{side}_lines"] = C.extract_code(code, numbers)
        texts[f"{side}_context"] = C.extract_code(code, C.other_line_numbers(code, numbers))
    return vocab.encode_text(functions.withColumns(texts), COLUMNS, found, vocab.SEQUENCE_MODEL).drop(*COLUMNS)
