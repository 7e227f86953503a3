"""Query of the BPE operator over all documents."""

from flowguard.llm.bpe import round_trip_digests
from flowguard.llm.common import table
from flowguard.llm.registry import query


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_bpe_round_trip")
def op8(spark, sf):
    return round_trip_digests(table(spark, sf, "documents"), vocabulary())
