"""SQL functions of the package for ``spark.sql``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tokenloom.functions.bytelevel import GPT2_PATTERN
from tokenloom.operators.bpe import encode_pieces_udf
from tokenloom.sources.model import BpeModel


def register_functions(spark: SparkSession, model: BpeModel) -> None:
    """``bpe_encode``, ``bpe_decode``, ``pack_u32`` and ``unpack_u32`` as temporary functions.

    All but the merging step are SQL expressions, inlined into the caller's plan.
    """
    spark.udf.register("bpe_encode_pieces", encode_pieces_udf(spark, model, use_added=False))
    table = json.dumps(model.decode_table()).replace("\\", "\\\\").replace("'", "\\'")
    bodies = {
        "bpe_encode(t string) returns array<int>":
            f"bpe_encode_pieces(regexp_extract_all(t, r\"{GPT2_PATTERN}\", 0))",
        "bpe_decode(ids array<int>) returns string":
            "make_valid_utf8(cast(encode(array_join(transform(ids, i -> coalesce(get("
            f"from_json('{table}', 'array<string>'), i), '')), ''), 'ISO-8859-1') as string))",
        "pack_u32(ids array<bigint>) returns binary":
            "unhex(array_join(transform(transform(ids, i -> lpad(hex(i & 4294967295), 8, '0')), "
            "h -> concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2))), ''))",
        "unpack_u32(b binary) returns array<bigint>":
            "transform(filter(regexp_extract_all(hex(b), '.{1,8}', 0), h -> length(h) = 8), h -> "
            "cast(conv(concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)), 16, 10) as bigint))",
    }
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
