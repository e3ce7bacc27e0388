"""All registered queries of this folder."""

from barline.llm import (  # noqa: F401
    conversation_trie,
    decontamination,
    jaccard_join,
    language,
    mixing,
    neighbour_graph,
    pii,
    quality_classifier,
    quality_rules,
    quotations,
    secrets,
    sharding,
    token_alignment,
)
from barline.llm.common import CHECKS, PLANS  # noqa: F401
