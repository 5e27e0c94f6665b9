"""Per-dataset column roles of the three raw datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple[str, ...]
    primary_key: str | None = None
    foreign_keys: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    datetimes: tuple[str, ...] = ()
    booleans: tuple[str, ...] = ()
    preprocess: tuple[str, ...] = ()
    schema: StructType = field(init=False, compare=False)

    def __post_init__(self) -> None:
        raw = StructType([StructField(c, StringType()) for c in self.columns])
        object.__setattr__(self, "schema", raw)

    @property
    def id_columns(self) -> tuple[str, ...]:
        return ((self.primary_key,) if self.primary_key else ()) + self.foreign_keys

    @property
    def parts_folder(self) -> str:
        return f"{self.name}_parts"


# Columns, keys and typed columns of the raw files (fixed values).
COMMENTS = Dataset(
    name="comments",
    columns=(
        "id", "product_id", "title", "body", "advantages", "disadvantages", "rate", "likes",
        "dislikes", "created_at", "is_buyer", "recommendation_status", "seller_title",
        "seller_code", "true_to_size_rate",
    ),
    primary_key="id",
    foreign_keys=("product_id",),
    numeric=("rate", "likes", "dislikes"),
    datetimes=("created_at",),
    booleans=("is_buyer",),
    preprocess=("title", "body", "advantages", "disadvantages"),
)

USER_BEHAVIOR = Dataset(
    name="user_behavior_logs",
    columns=("user_id", "product_id", "session_id", "event_type", "timestamp", "city"),
    foreign_keys=("user_id", "product_id"),
    datetimes=("timestamp",),
)

PRODUCTS = Dataset(
    name="products",
    columns=(
        "id", "title_fa", "Category1", "Category2", "sub_category", "Brand", "Seller", "Price",
        "min_price_last_month", "Rate", "Rate_cnt", "Is_Fake",
    ),
    primary_key="id",
    numeric=("Rate", "Rate_cnt", "Price", "min_price_last_month"),
    booleans=("Is_Fake",),
    preprocess=("title_fa",),
)

DATASETS = {d.name: d for d in (COMMENTS, USER_BEHAVIOR, PRODUCTS)}

# Event types of the behaviour log (fixed values).
EVENT_TYPES = ("view", "add_to_cart", "remove_from_cart", "purchase")


def find_dataset(name: str) -> Dataset | None:
    """The registered dataset, or None for a name that should be skipped."""
    return DATASETS.get(name)
