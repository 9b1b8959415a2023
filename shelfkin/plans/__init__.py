"""End-to-end jobs put together from sources and operators."""
