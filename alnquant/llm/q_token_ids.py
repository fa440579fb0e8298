"""Registered query of operator 5."""

from . import common as C
from . import simple8b


def op5_token_ids(spark, sf_dir):
    import public_tokenizers

    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return simple8b.read_ids(simple8b.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


QUERIES = {"op5_token_ids": op5_token_ids}
