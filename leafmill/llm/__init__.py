"""Training-data operators. Nothing else in the library imports this subpackage.

What holds for all of them: texts are processed whole, whatever their length; a
null text counts as an empty one; repeated rows give a row each; equal keys are
ordered by the text or count as one, as the operator says; an empty table gives
an empty result. Operators select the columns they need, so further columns do
not matter, whatever their names are; those that filter or change documents
carry all columns along. Ids may be null.
"""
