"""Operations of a training-data pipeline over ``documents``-like tables."""
