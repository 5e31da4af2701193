"""Text → vector batch inference.

The default encoder is a deterministic hashed bag of words built from
Spark ML stages (tokenise → HashingTF → L2 normalise), fully JVM-side. A
model encoder can be passed instead: it runs in ``mapInPandas`` over Arrow
batches and is built once per task by a factory, never per row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_texts(df: DataFrame, text_col: str = "text", id_col: str = "repository_id",
                dim: int = 384, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None
                ) -> DataFrame:
    """→ id_col, embedding ARRAY<FLOAT> (unit norm; empty text → zeros)."""
    base = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if encoder_factory is None:
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+",
                             toLowercase=True, minTokenLength=1)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
        x = norm.transform(tf.transform(tok.transform(base)))
        return x.select(id_col, vector_to_array("_vec", "float32").alias("embedding"))

    def run(batches):
        encode = encoder_factory()  # once per task
        for pdf in batches:
            vecs = np.asarray(encode(pdf["_text"].tolist()), dtype=np.float32)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "embedding": list(vecs)})

    return base.mapInPandas(run, f"{id_col} long, embedding array<float>")
