"""Models over ring values: naive Bayes, logistic regression, trees and forests."""
