"""Query of best-fit packing over all documents."""

from flowguard.llm.common import table
from flowguard.llm.packing import packed_pieces
from flowguard.llm.registry import query


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_best_fit_packing")
def op11(spark, sf):
    return packed_pieces(table(spark, sf, "documents"), vocabulary())
