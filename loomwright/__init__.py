"""Loomwright: Spark DataFrame operators for table migration, editing, catalog comparison and export."""
