"""Operations for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. Each operator lives in a
module of its own; ``queries`` binds them to the tables of the test data.
"""
