"""Queries of the driver contract and the SQL that checks them."""
