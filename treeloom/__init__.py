"""treeloom: mining change patterns from paired, tree-structured and token-structured records with PySpark."""
