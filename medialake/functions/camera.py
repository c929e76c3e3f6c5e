"""Camera profile from make, model and lens tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Makes and model marks of each kind of camera.
MOBILE_MAKES = ("APPLE", "SAMSUNG", "XIAOMI", "HUAWEI", "GOOGLE", "ONEPLUS", "OPPO", "VIVO")
ACTION_MAKES = ("GOPRO", "DJI", "INSTA360")
SYSTEM_MAKES = ("SONY", "CANON", "NIKON", "PENTAX", "FUJIFILM")
SCANNER_MARKS = ("SCANNER", "FILM")
MIRRORLESS_MARKS = ("EOS R", "Z5", "Z6", "Z7", "Z8", "Z9", "A7", "A6", "S5", "S1", "X-T", "X-H")


def _key(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"^\s+|\s+$", ""))


def camera_profile(make: Column, model: Column, has_lens: Column) -> Column:
    """First rule that holds; a make must match whole, a model mark anywhere."""
    brand, name = _key(make), F.coalesce(_key(model), F.lit(""))
    holds = lambda marks: name.rlike("|".join(marks))
    return (
        F.when(make.isNull() | (make == ""), "unknown")
        .when(brand.isin(*MOBILE_MAKES), "mobile")
        .when(brand.isin(*ACTION_MAKES), "action_cam")
        .when(holds(SCANNER_MARKS), "film_scanner")
        .when(holds(MIRRORLESS_MARKS), "mirrorless")
        .when(brand.isin(*SYSTEM_MAKES), F.when(has_lens, "dslr").otherwise("mirrorless"))
        .otherwise("unknown")
    )
