"""Column-expression helpers (pure Catalyst, no Python workers)."""

from .numeric import round4, null_as_zero_flag, exact_sum, mean_of
from .timeparse import complete_time, parse_time, to_day
from .labels import (LABELS, class_to_label, class_to_sign, label_to_class, label_to_sign,
                     softmax3, argmax3)
from .keywords import KEYWORDS, mention_count

__all__ = [
    "round4", "null_as_zero_flag", "exact_sum", "mean_of",
    "complete_time", "parse_time", "to_day",
    "LABELS", "class_to_label", "class_to_sign", "label_to_class", "label_to_sign", "softmax3", "argmax3",
    "KEYWORDS", "mention_count",
]
