"""Named queries over the local tables and their SQL counterparts."""
