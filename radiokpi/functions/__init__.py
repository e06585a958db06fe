from radiokpi.functions.columns import (
    blank_to_null, counter_number, entity_level, logical_entity_key, safe_ratio, stamp, strip_space,
)
from radiokpi.functions.ordering import first_per, page, sort_keys

__all__ = [
    "blank_to_null", "counter_number", "entity_level", "logical_entity_key", "safe_ratio", "stamp",
    "strip_space", "first_per", "page", "sort_keys",
]
