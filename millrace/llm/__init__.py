"""Operations of a training-data pipeline over documents (doc_id, text, ...). Nothing outside imports this package."""
