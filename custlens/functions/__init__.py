"""Column expressions (JVM-side) and driver-side distribution tails."""

from custlens.functions.columns import (
    clean_num,
    hash_unit,
    kurt_g2,
    skew_g1,
    strength_label,
)

__all__ = ["clean_num", "hash_unit", "kurt_g2", "skew_g1", "strength_label"]
