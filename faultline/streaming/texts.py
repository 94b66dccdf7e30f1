"""The stateless text operators on streams: the same columns, no state, no sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import clean_code, line_count, tokenize_code
from faultline.operators.clean import MAX_LINES
from faultline.operators.splits import assign_split
from faultline.operators.vocab import Dictionary, pad


def prepare_stream(functions: DataFrame, key: str, code: str) -> DataFrame:
    """Clean, drop long functions, assign the split and tokenize."""
    cleaned = functions.withColumn(code, clean_code(code)).filter(line_count(code) <= MAX_LINES)
    return assign_split(cleaned, key).withColumn("tokens", tokenize_code(code))


def encode_stream(prepared: DataFrame, dictionary: Dictionary, model: dict[str, int], out: str = "ids") -> DataFrame:
    """Padded id sequences from a dictionary that was fitted on a batch table."""
    ids = dictionary.ids_of(F.slice("tokens", 1, model["length"]), model["unknown"])
    return prepared.withColumn(out, pad(ids, model["length"], model["pad"]))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Process everything that is there, write Parquet, stop. The checkpoint makes a restart exactly-once."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
