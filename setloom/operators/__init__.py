"""Operators over set frames (id), collections (set_id, id), vector frames (idx, value), edges (src, dst), intervals."""
