"""Rule-ordered normalisation of product names, as one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicebox.functions.expressions import normalise_string

#: Fixed values, applied in this order: characters, missing letters, brands.
CHARACTERS = {"T0": "To", "l1": "li", "O0": "Oo", "S5": "Ss"}
MISSING_LETTERS = {"Chagrer": "Charger", "Aiir": "Air", "Chmes": "Chimes", "MacBoko": "MacBook", "Gaame": "Game", "Kitt": "Kit", "Bl0cks": "Blocks"}
BRANDS = {"iphone": "iPhone", "ipad": "iPad", "macbook": "MacBook", "samsung galaxy": "Samsung Galaxy", "google pixel": "Google Pixel"}


def normalise_product_name(column: Column) -> Column:
    """Characters, missing letters (whole words), spaces before model numbers, separators, brand case, single spaces."""
    name = normalise_string(column)
    for wrong, right in CHARACTERS.items():
        name = F.replace(name, F.lit(wrong), F.lit(right))
    for wrong, right in MISSING_LETTERS.items():
        name = F.regexp_replace(name, rf"\b{wrong}\b", right)
    name = F.regexp_replace(name, r"([A-Za-z]{3,})([0-9])", "$1 $2")
    name = F.regexp_replace(name, r"[_-]+", " ")
    for brand, written in BRANDS.items():
        name = F.regexp_replace(name, rf"(?i)\b{brand}\b", written)
    return F.trim(F.regexp_replace(name, r"\s+", " "))
