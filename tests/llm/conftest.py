import os
import sys

# tests here use one another's plain versions
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
