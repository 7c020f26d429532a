from lakeclerk.sources.files import check_schema, read_csv, read_parquet, text_schema

from lakeclerk.sources.listing import register_listing

__all__ = ["check_schema", "read_csv", "read_parquet", "register_listing", "text_schema"]
