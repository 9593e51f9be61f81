"""The library's queries by the names of its operators."""
