from kiln.sources.tables import TABLES, image_table, read_table, register_views, table_path

__all__ = ["TABLES", "image_table", "read_table", "register_views", "table_path"]
