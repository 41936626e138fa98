"""Operations of training-data pipelines: one module for each operator, their queries in ``queries``."""
