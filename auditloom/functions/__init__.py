"""Part of auditloom."""
