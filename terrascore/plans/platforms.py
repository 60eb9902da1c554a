"""Contracts of the two report platforms' landing and curated tables."""

from __future__ import annotations

from terrascore.operators.contracts import Contract

ZONED = "timestamp with time zone"

CONTRACTS = {
    "l0_steam_raw": Contract(
        required=["id", "source_name", "report_type", "report_period", "batch_id", "payload", "created_at", "loaded_at"],
        optional=["file_name", "file_path", "content", "metadata", "extraction_date"],
        types={
            "id": "bigint",
            "source_name": "text",
            "report_type": "text",
            "report_period": "date",
            "batch_id": "text",
            "payload": "jsonb",
            "created_at": ZONED,
            "loaded_at": ZONED,
        },
    ),
    "l1_steam_sales_country": Contract(
        required=["report_period", "country", "sku", "platform", "net_units", "net_usd", "legal_entity"],
        optional=["currency", "loaded_at"],
        types={
            "report_period": "date",
            "country": "text",
            "sku": "text",
            "platform": "text",
            "net_units": "bigint",
            "net_usd": "numeric",
            "legal_entity": "text",
        },
    ),
    "l1_steam_revenue_share_country": Contract(
        required=["report_period", "country", "sku", "platform", "revenue_share_usd", "legal_entity"],
        types={"revenue_share_usd": "numeric"},
    ),
    "steam_highwatermark": Contract(
        required=["source_name", "watermark_date", "grace_days", "updated_at"],
        optional=["notes"],
        types={"source_name": "text", "watermark_date": "date", "grace_days": "smallint", "updated_at": ZONED},
    ),
    "l0_sony_raw": Contract(
        required=["id", "source_name", "batch_id", "extraction_date", "payload", "created_at"],
        optional=["file_name", "file_path", "record_hash", "content", "report_type", "report_period", "legal_entity", "loaded_at"],
        types={
            "id": "bigint",
            "source_name": "text",
            "batch_id": "text",
            "extraction_date": "date",
            "payload": "jsonb",
            "created_at": ZONED,
        },
    ),
    "l1_sony_financials": Contract(
        required=["id", "batch_id", "transaction_date", "product_id", "gross_revenue_usd"],
        optional=[
            "extraction_date",
            "event_date",
            "product_name",
            "country_code",
            "country_name",
            "legal_entity",
            "net_revenue_usd",
            "currency",
            "units_sold",
            "created_at",
            "processed_at",
        ],
        types={"gross_revenue_usd": "numeric", "transaction_date": "date"},
    ),
}

# Core columns of the relaxed check.
CORE_COLUMNS = {
    "l0_steam_raw": ["id", "source_name", "payload"],
    "l1_steam_sales_country": ["report_period", "country", "sku", "platform"],
    "l1_steam_revenue_share_country": ["report_period", "country", "sku", "platform"],
    "steam_highwatermark": ["source_name", "watermark_date", "grace_days", "updated_at"],
    "l0_sony_raw": ["id", "source_name", "payload"],
    "l1_sony_financials": ["id"],
}
