"""Registered query of operator 8."""

from . import common as C
from . import wfst


def op8_sentencepiece(spark, sf_dir):
    import public_tokenizers

    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return wfst.transduce(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_ids", "n_fallback", "ids_crc32", "round_trip"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
