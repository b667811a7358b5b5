"""attestry: evidence checks and dossiers over Spark tables."""
