"""newsloom: news-dossier analytics expressed as Spark DataFrame functions."""
