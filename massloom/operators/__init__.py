"""massloom.operators"""
