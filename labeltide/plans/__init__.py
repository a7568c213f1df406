"""End-to-end plans (``evaluate``), registered queries (``catalog``) and SQL oracles (``oracle``)."""
