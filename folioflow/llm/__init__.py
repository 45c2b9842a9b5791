"""Operations of a training-data pipeline over very large document collections."""
