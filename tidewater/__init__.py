"""Tidewater: transactional stream analytics and a relational query layer on PySpark."""
