"""MLlib estimators: features, positive-unlabeled forest, one-vs-rest SVM."""
