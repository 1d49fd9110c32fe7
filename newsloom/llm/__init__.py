"""Operators for preparing language-model training text.

Conventions shared by every operator here:

* the id column names the document; repeated rows of an id are one document and
  share its decision, rows with a null id are never reported and never dropped;
* null text is treated like empty text;
* only the named columns are read, so extra columns, whatever their names, pass
  through the stages untouched and never reach the reports.
"""
