from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from martloom.plans.warehouse import Warehouse  # noqa: E402
from martloom.schemas import LANDED  # noqa: E402
from martloom.session import local_session  # noqa: E402
from martloom.workspace import Workspace  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session("tests", cores=4, memory="8g", **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "work"))


@pytest.fixture
def staging(spark):
    """Landed rows from dicts; ids count up inside a file unless they are given."""

    def make(*rows: dict, partitions: int = 1):
        seen: dict[str, int] = {}
        complete = []
        for row in rows:
            file = row.get("_src_file", "A")
            seen[file] = seen.get(file, 0) + 1
            row = {"_src_file": file, "_src_id": seen[file], **row}
            row.setdefault("id", row["_src_id"])
            complete.append(tuple(row.get(name) for name in LANDED.names))
        return spark.createDataFrame(complete, LANDED).repartition(partitions)

    return make


@pytest.fixture
def warehouse(ws, staging):
    def make(*rows: dict, partitions: int = 1, **kwargs) -> Warehouse:
        return Warehouse.land(staging(*rows, partitions=partitions), ws, **kwargs)

    return make


def sale(**columns) -> dict:
    """A complete sale; give only what matters."""
    return {
        "sale_date": "5/1/2021",
        "sale_customer_id": "1",
        "sale_seller_id": "1",
        "sale_product_id": "1",
        "sale_quantity": "1",
        "sale_total_price": "10.00",
        "customer_first_name": "Ann",
        "customer_last_name": "Lee",
        "customer_country": "Peru",
        "customer_pet_type": "cat",
        "pet_category": "Cats",
        "product_name": "Bowl",
        "product_category": "Food",
        "product_price": "10.00",
        "product_rating": "4.5",
        "product_reviews": "7",
        "supplier_name": "Acme",
        "supplier_city": "Oslo",
        "supplier_country": "Norway",
        "store_name": "Shop",
        "store_city": "Lima",
        "store_country": "Peru",
        **columns,
    }


def rows(df, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, v) for v in r])
